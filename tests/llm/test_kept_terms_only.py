import random

import pyarrow as pa

from riskweave.llm import divergence


def test_nothing_is_written_of_terms_that_are_not_kept(spark, monkeypatch):
    sizes = []

    def written(df, name, **options):
        out = original(df, name, **options)
        sizes.append(out.count())
        return out

    original = divergence.written
    monkeypatch.setattr(divergence, "written", written)
    rows = [("en", f"s{k % 2}", "the end " + " ".join(f"w{k}x{i} " + chr(97 + i) * (k + 2) for i in range(20))) for k in range(40)]
    divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    assert max(sizes) < 100  # 23 kept terms, two sources; 800 other chunks


def test_slabs_give_what_all_rows_at_once_give():
    r = random.Random(4)
    # Name 5 is that of two keys, and of many rows more than a slab holds.
    rows = [(n, r.choice(["en", "de"]), f"k{n}" if n != 5 else r.choice(["k5", "l5"])) for n in sorted(r.choice([1, 2, 3, 5, 5, 5, 5, 5, 5, 9]) for _ in range(600))]
    want, batches = {}, []
    for name, lang, key in rows:
        docs = [r.randrange(10**12 if name == 3 else 6) for _ in range(r.randrange(3))]
        docs, source, n = None if r.random() < 0.002 else sorted(set(docs)), r.randrange(3), r.randrange(1, 5)
        counts, all_docs = want.setdefault((name, lang, key), ({}, set()))
        counts[source] = counts.get(source, 0) + n
        all_docs.update(range(10) if docs is None else docs)
        batches.append(((name, lang, key), [-1 if docs is None else 1, source, n, *(docs or [])]))
    table = pa.table({"name": [x[0][0] for x in batches], "lang": [x[0][1] for x in batches], "key": [x[0][2] for x in batches], "counts": pa.array([x[1] for x in batches], pa.list_(pa.int64()))})
    for slab in (300, 1 << 20):
        got, names = {}, []
        for part in divergence._met(iter(table.to_batches(max_chunksize=7)), 10, slab):
            names.append(set(part["name"].to_pylist()))
            for x in part.to_pylist():
                per = abs(x["counts"][0])
                counts = dict(zip(x["counts"][1 : 1 + per], x["counts"][1 + per : 1 + 2 * per], strict=True))
                assert (x["name"], x["lang"], x["key"]) not in got
                got[x["name"], x["lang"], x["key"]] = counts, None if x["counts"][0] < 0 else x["counts"][1 + 2 * per :]
        assert got == {k: (c, None if len(d) >= 10 else sorted(d)) for k, (c, d) in want.items()}
        assert sum(map(len, names)) == len(set().union(*names)) == 5  # all rows of a name come in one table


def test_a_term_in_ten_documents_through_chunks_that_share_documents(spark):
    # Each document has the term in two chunks, so the union is nine documents and the sum of the lists eighteen.
    nine = [("en", "a", f"n-{k} ({k}n) x") for k in range(9)] + [("en", "b", "x")]
    ten = [("en", "a", f"t-{k} ({k}t)") for k in range(5)] + [("en", "b", f"t_{k} t") for k in range(5)]
    frame = spark.createDataFrame(nine + ten, "lang string, source string, text string").repartition(5)
    got = divergence.kept_terms(divergence.chunk_terms(divergence.chunk_counts(frame.withColumn("code", frame.source.substr(1, 1) == "a").selectExpr("lang", "cast(code as long) code", "text"), 10), 10), 10)
    assert sorted((x["lang"], x["term"], sorted(zip(x["sources"], x["ns"], strict=True))) for x in got.collect()) == [("en", "t", [(0, 10), (1, 10)]), ("en", "x", [(0, 1), (1, 9)])]
