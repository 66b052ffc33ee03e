import zlib

import numpy as np

from quernstone.llm import toxicity_zstd as T


def test_windows_cover_the_words():
    for t in ("", " ", "one", "one two " * 500, "x" * 5000, "É è\n\tß " * 99):
        w = T.windows(t)
        assert b"".join(x[:-1] for x in w).split() == t.lower().encode().split() or len(t.split()) == 1
        assert max(map(len, w)) <= 4 * T.WINDOW + 1


def test_telling_fragments_are_cheap_in_the_toxic_dictionary():
    rng = np.random.default_rng(1)
    plain = [" ".join(f"w{rng.integers(500)}" for _ in range(80)) for _ in range(300)]
    toxic = [p.replace(" w1", " scoundrel w1", 3) for p in plain[:100]]
    pair = T.dictionaries(plain[100:], toxic)
    assert len(pair[0]) == len(pair[1]) and b"scoundr" in pair[1] and b"scoundr" not in pair[0]  # the trainer cuts where it likes
    m = T.Distance(pair)
    gain = lambda t: int((m.histogram(t) * np.arange(T.LOW, T.HIGH + 1)).sum())
    assert gain("w7 w9 scoundrel w8") > gain("w7 w9 w8 w77")


def test_scores_against_a_plain_version():
    """Windows by words, each compressed anew, gains counted one by one, and the fit's formula."""
    import zstandard

    rng = np.random.default_rng(2)
    words = lambda n: " ".join(f"w{rng.integers(300)}" for _ in range(n))
    ordinary, toxic = [words(rng.integers(1, 300)) for _ in range(200)], [words(60) + " vermin " + words(60) + " vermins" for _ in range(60)]
    m = T.Distance(T.dictionaries(ordinary[:150], toxic[:40]))
    m.calibrate(np.array([m.histogram(t) for t in ordinary[150:] + toxic[40:]]), np.array([0] * 50 + [1] * 20))
    parameters = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3, window_log=17, chain_log=14, hash_log=14, search_log=4, target_length=24, strategy=zstandard.STRATEGY_BTOPT)

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress(window))

    mean, spread, w = m.fit
    for text in ["", "Vermin!", words(500), words(40) + " VERMIN " + words(200)]:
        parts, now = [], b" "
        for word in text.lower().encode().split():
            now += word + b" "
            if len(now) > T.WINDOW:
                parts, now = [*parts, now], b" "
        if len(now) > 1 or not parts:
            parts.append(now)
        gains = [min(max(length(p, m.pair[0]) - length(p, m.pair[1]), T.LOW), T.HIGH) for p in parts]
        s, n = sum(m.ratios[g - T.LOW] for g in gains), len(gains)
        up, far = (sum(g >= k for g in gains) for k in T.SAVES)
        x = (np.array([s, s / n**0.5, up**0.5, (up / n) ** 0.5, (far / n) ** 0.5, np.log(n)]) - mean) / spread
        want = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        assert abs(m.score(np.array([m.histogram(text)]))[0] - want) < 1e-9


def test_held_out_accuracy_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = T.scored(some, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out]
    rank = held.score.rank()
    n1, n0 = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    auc = (rank[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    print("AUC", auc, "recall", held.predicted[held.toxic == 1].mean(), "false", held.predicted[held.toxic == 0].mean())
    assert auc > 0.75  # two fifths of the toxic labels of this table mark texts that nothing tells apart
    texts = some.toPandas().set_index("doc_id").text
    rude = held.doc_id.map(lambda d: sum(w in texts[d].lower() for w in ("idiot", "moron", "scum", "pathetic", "worthless", "clown")) > 1)
    assert held.predicted[rude].mean() > 0.9 and held.predicted[~rude].mean() < 0.05
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, "")], "doc_id long, text string").selectExpr("*", "text as score")
    assert T.scored(odd, labels).count() == 4
    assert (T.scored(odd, labels.limit(0)).toPandas().score == 0).all()
    assert T.scored(odd.limit(0), labels).count() == 0


def test_common_part_is_trained_on_all_words():
    from quernstone.llm import toxicity_zstd

    late = "zebra zenith zephyr zigzag zodiac zoology"
    ordinary = [" ".join(f"a{i:03d}x{k:03d}" for k in range(90)) + " " + late for i in range(200)]
    common, _ = toxicity_zstd.dictionaries(ordinary, [])
    assert any(w.encode() in common for w in late.split())
