"""Each stage of the pipeline on its own input."""

import tracemalloc
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.llm import common, langid, mixing, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    told = P.language(spark, docs, SF).cache()
    assert told.columns == columns and told.count() >= 0.9 * docs.count()
    assert told.exceptAll(docs).count() == 0
    assert told.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).count() == 0

    kept = P.near_dedup(spark, told, SF).cache()
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(told, words=P.WORDS, least=P.SIMILARITY).collect()}
    assert kept.columns == columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))

    clean = P.secret_scan(spark, kept, SF).cache()
    assert clean.columns == columns and clean.count() == kept.count()
    assert secrets.digest(clean).filter("n_assign + n_access + n_hex > 0").count() == 0
    assert clean.filter("n_chars <> length(text)").count() == 0

    mixed = P.mixing_weights(spark, clean, SF).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert mixed.columns == columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    packed = P.pack(spark, mixed, SF)
    assert packed.agg(F.sum("n_tokens")).first()[0] == mixed.select(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))).first()[0]


def test_run(spark):
    assert P.run(spark, SF).count() > 0 and [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "no id", "en", "a", 5), (2, "", "en", None, 0), (3, "plain words here", "en", "a", 16), (3, "plain words here", "en", "a", 16), (4, "wörter ohne sinn", "de", "b", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    P.pack(spark, docs, SF).collect()
    empty = docs.filter("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_take_long_texts_ties_and_other_columns(spark):
    long = " ".join(f"the{k} words" for k in range(15_000))
    rows = [(i, f"{long} {i} end", "en", "a", 0, 1, "x", 2) for i in range(3)] + [(9, "short words of a text here", "en", None, 0, 1, "x", 2)] * 2 + [(10, "short words of a text here", "en", "b", 0, 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy int, node string, stays int")
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    kept = {r["doc_id"] for r in P.near_dedup(spark, spark.createDataFrame(rows, docs.schema), SF).collect()}
    assert kept == {0, 9}  # near copies of the long text, and a tie of equal texts: the smallest ids
    assert P.pack(spark, docs, SF).filter("n_tokens > 2048").count() == 0


def test_unknown_language_goes(spark):
    docs = spark.createDataFrame([(1, "12 34", "en", "a", 5), (2, "the words of this text", "en", "a", 22), (3, "les mots de ce texte", "fr", "a", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.UNKNOWN == "und" and 1 not in {r["doc_id"] for r in P.language(spark, docs, SF).collect()}


def test_near_dedup_checks_texts(spark):
    """Equal fingerprints of unlike texts, and one id on unlike texts, are no copies; equal rows are."""
    line = "the seven words of this very line " * 100
    texts = [line + " ".join(f"{who}{k}" for k in range(40)) for who in "ab"]
    assert simhash.fingerprint(texts[0], P.WORDS) == simhash.fingerprint(texts[1], P.WORDS)
    plain = [" ".join(f"{who}{k}" for k in range(60)) for who in "cde"]
    near = plain[2] + " end"
    rows = [(1, texts[0]), (2, texts[1]), (3, plain[0]), (3, plain[1]), (3, plain[1]), (4, plain[2]), (5, near), (5, "quite another text of this id"), (None, plain[2])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, SF).collect())
    assert got == Counter([(1, texts[0]), (2, texts[1]), (3, plain[0]), (3, plain[1]), (4, plain[2]), (5, rows[7][1]), (None, plain[2])])


def test_workers_get_small_batches(spark):
    """Texts of 19 MB in few rows: a Python worker is never sent much more than BATCH_BYTES of them, where Spark's own limit is 10,000 rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("abc "), 12000)).alias("text"), F.lit("en").alias("lang"))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

        told = P.language(spark, docs, SF)
        sent = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in sent) == 400 and max(r["bytes"] for r in sent) < 1.1 * common.BATCH_BYTES
        back = told.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in back) == 400
        spark.conf.set(name, "1m")  # a smaller limit of the session's own stays
        common.small_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_sketches_are_compared_in_bounded_memory():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 62, (300, 64)).astype(np.uint64)
    sketches = simhash.Sketches([w.tobytes() for w in words])
    x, y = rng.integers(0, 300, 20000), rng.integers(0, 300, 20000)
    tracemalloc.start()
    try:
        got = sketches.apart(x, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.tolist() == [int(np.bitwise_count(words[a] ^ words[b]).sum()) for a, b in zip(x, y, strict=True)]
    assert peak < 8 << 20  # 28 MB in steps of 16,384 pairs of any width


def test_near_dedup_finds_copies_that_share_frequent_shingles_only(spark, monkeypatch):
    """Sets with a shingle of very many texts are dealt over buckets; two copies that are dealt apart, and are alone with
    their size there, still meet."""
    monkeypatch.setattr(simhash, "CROWDED", 1)
    monkeypatch.setattr(simhash, "PREFIXES", 64)
    texts = []
    for k in range(6):  # two near copies, whose shared shingles are in 30 long texts too
        common = " ".join(f"c{k}x{i}" for i in range(22))
        texts += [f"{common} one{k} two{k}", f"{common} three{k} four{k}"]
        texts += [f"{common} " + " ".join(f"w{k}x{j}x{i}" for i in range(60 + 4 * j)) for j in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [set(simhash.shingle_hashes(t, P.WORDS).tolist()) for t in texts]
    copies = {j for i in range(0, len(texts), 32) for j in range(i + 1, i + 32) if any(len(sets[j] & sets[h]) >= P.SIMILARITY * len(sets[j] | sets[h]) for h in range(i, j))}
    assert copies == {32 * k + 1 for k in range(6)}
    assert {r["doc_id"] for r in P.near_dedup(spark, docs, SF).collect()} == set(range(len(texts))) - copies
