import duckdb
import numpy as np
from compare import rows as table
from compare import sql_rows
from compare import SF
from test_dedup import brute_classes, brute_words, words

import corpus_pipeline
from graphloom.llm import decontamination, mixing, quality_classifier


def test_run_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    net = quality_classifier.trained(spark, SF)
    kept = []
    for d in docs:
        b = np.frombuffer((d[1] or "").encode(), np.uint8)
        if net.scores(b, np.array([0, len(b)]))[0] >= quality_classifier.THRESHOLD:
            kept.append(d)
    least = {i: c for i, _, c in brute_classes([d[:2] for d in kept])}
    kept = [d for d in kept if least[d[0]] == d[0]]
    removed, out = {i: (n, g) for i, n, g, _ in brute_words([d[:2] for d in kept], 13)}, []
    first = {}
    for i, t, *_ in sorted(kept):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t, *more in kept:
        n, g = removed[i]
        if g == 0:
            out.append((i, t, *more))
        elif g < n:
            w = words(t)
            gone = {x for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for x in range(j, j + 13)}
            out.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode(), *more))
    items = [decontamination.shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = [d for d in out if not any(q and 10 * len(q & decontamination.shingles(d[1])) >= 8 * len(q) for q in items)]
    assert 50 < len(out) < len(docs)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", out)
    assert table(corpus_pipeline.run(spark, SF)) == sql_rows(con, mixing.ORACLE_SQL)


def test_stages_on_empty_and_odd_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).withColumn("extra", F.lit(1))
    for df in (docs.limit(0), odd):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, SF)
            assert i == 4 or out.columns == df.columns
            assert out.count() <= df.count()
