"""Schema rewrite, centroid clustering and pieces against brute force and on odd tables."""

import datetime
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspan.llm import centroids, language_id, near_dedup, pieces, quality_classifier, schema_rewrite, toxicity

SF = "/root/testdata/sf0.001"
NAMES = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ 11


def rewritten(rows, files=1000):
    """By brute force, of rows without equal ids: file_no to (version, n_rows, n_nulls, ids, rows)."""
    rows = sorted(rows, key=lambda r: (r["client_id"] is not None, zlib.crc32(str(r["client_id"]).encode()) if r["client_id"] is not None else 0, r["client_id"] or 0))
    size, out = 1 + len(rows) // files, {}
    for no in range(-(-len(rows) // size)):
        v = zlib.crc32(f"7:{no}".encode()) % 24
        v = v if v < 16 else 0
        lines, nulls = [], 0
        part = [dict(r) for r in rows[no * size : (no + 1) * size]]
        for r in part:
            if v & 4:
                r |= {"nation_id": -1, "city": "none"}
            if v & 8 and r["balance"] is not None:
                r["balance"] = float(np.float32(r["balance"]))
            nulls += sum(r[n] is None for n in NAMES)
            if r["updated_at"] is not None:
                r["updated_at"] = (r["updated_at"] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
            if r["balance"] is not None:
                r["balance"] = math.floor(1048576 * r["balance"]) if math.isfinite(r["balance"]) else r["balance"]
            lines.append("|".join("?" if r[n] is None else str(r[n]) for n in NAMES))
        out[no] = (v, len(part), nulls, sha(",".join("?" if r["client_id"] is None else str(r["client_id"]) for r in part)), sha("\n".join(lines)))
    return out


def reported(df):
    return {r["file_no"]: (r["version"], r["n_rows"], r["n_nulls"], r["ids_sha256"], r["rows_sha256"]) for r in df.collect()}


def test_rewrite_equals_brute_force_and_leaves_one_schema(spark):
    df = schema_rewrite.op11_schema_rewrite(spark, SF)
    rows = pq.read_table(f"{SF}/clients.parquet").to_pylist()
    assert reported(df) == rewritten(rows)
    got = df.collect()
    folder = os.path.dirname(got[0]["path"].removeprefix("file:").replace("//", "/"))
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r["path"]) for r in got)  # no other file
    seen = set()
    for r in got:
        schema = pq.read_schema(f"{folder}/{os.path.basename(r['path'])}")
        assert schema.equals(schema_rewrite.CLIENTS, check_metadata=True)
        assert r["columns"] == ",".join(NAMES) and r["rewritten"] == (r["version"] > 0)
        start = NAMES if not r["version"] else None
        if r["version"] & 1:
            start = ["email" if n == "name" else "name" if n == "email" else n for n in NAMES]
        start = list(start or NAMES)
        if r["version"] & 4:
            start = [n for n in start if n not in ("nation_id", "city")]
        if r["version"] & 2:
            start = start[:1] + start[:0:-1]
        assert r["start_columns"] == ",".join(start)
        seen.add(r["version"])
    assert seen == set(range(16))


@pytest.mark.parametrize("version", range(16))
def test_drifted_schema_keeps_ids_and_values(version):
    schema, places = schema_rewrite.drift(schema_rewrite.CLIENTS, version)
    ids = schema_rewrite._ids(schema)
    assert ids == [p + 1 for p in places] and ids[0] == 1 and len(ids) == (8 if version & 4 else 10)
    kinds = dict(zip(ids, schema.types, strict=True))
    assert kinds[10] == (pa.float32() if version & 8 else pa.float64())
    assert version & 4 or kinds[8] == (pa.int32() if version & 8 else pa.int64())


def odd_clients():
    t = datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)
    return [
        (None, 1, "a", t, "n", "e", "c", 1, "s", 1.5), (1, None, None, None, None, None, None, None, None, None), (2, 2, "", t, "a|b", "line\nbreak", "ü🎉", -5, "?", -0.0000001),
        (3, 3, "x" * 100_000, t, "n", "e", "c", 1, "s", float("nan")), (4, 3, "b", t, "n", "e", "c", 1, "s", 1e300), (5, 3, "b", t, "n", "e", "c", 1, "s", float("-inf")), (6, 3, "b", t, "n", "e", "c", 1, "s", 9.007e15),
    ]


@pytest.mark.parametrize("files", [1, 3, 1000])
@pytest.mark.filterwarnings("ignore:overflow")
def test_rewrite_of_odd_rows(spark, files):
    df = spark.createDataFrame(odd_clients(), CLIENT).withColumns({"file_no": F.lit("clash"), "__range": F.lit(1), "a.b": F.lit(2)})
    got = reported(schema_rewrite.drift_and_rewrite(df, schema_rewrite.new_folder(spark, "odd"), files))
    want = rewritten([dict(zip(NAMES, r, strict=True)) for r in odd_clients()], files)
    assert got == want


def test_rewrite_of_equal_rows_and_of_none(spark):
    row = (7, 7, "s", None, "n", "e", "c", 1, "g", 2.0)
    df = spark.createDataFrame([row] * 500 + [(i, 0, "s", None, "n", "e", "c", 1, "g", 2.0) for i in range(8, 60)], CLIENT).repartition(7)
    got = reported(schema_rewrite.drift_and_rewrite(df, schema_rewrite.new_folder(spark, "equal"), 20))
    assert got == rewritten([r.asDict() for r in df.collect()], 20) and len(got) == 20 + (552 % 28 > 0) - 1 + (552 // 28 - 19)
    assert schema_rewrite.drift_and_rewrite(df.limit(0), schema_rewrite.new_folder(spark, "none")).count() == 0


def test_rewrite_streams_batches_and_may_run_again(spark, tmp_path, monkeypatch):
    n = 5000
    r = random.Random(1)
    rows = {"client_id": list(range(n)), "balance": [r.uniform(-9, 9) if i % 7 else None for i in range(n)]}
    folder = schema_rewrite.Folder(f"file://{tmp_path}/f")
    table = pa.table([pa.array(rows.get(f.name, [None] * n), f.type) for f in schema_rewrite.CLIENTS], schema=schema_rewrite.CLIENTS)
    start, places = schema_rewrite.drift(schema_rewrite.CLIENTS, 15)
    w = folder.write("start", start)
    w.add([table.column(k).combine_chunks().cast(f.type, safe=False) for k, f in zip(places, start, strict=True)])
    assert not os.path.exists(tmp_path / "f/start")  # there only when it's complete
    w.close()
    whole = schema_rewrite.rewrite_file(folder, "start", "end")
    monkeypatch.setattr(schema_rewrite, "BATCH_ROWS", 64)
    lost = folder.write("end2", schema_rewrite.CLIENTS)  # of a task that was lost
    parts = schema_rewrite.rewrite_file(folder, "start", "end2")
    again = schema_rewrite.rewrite_file(folder, "start", "end2")
    del lost
    assert whole[0].lines.digest() == parts[0].lines.digest() == again[0].lines.digest() and whole[0].rows == n and parts[3] == "end2"
    assert sorted(os.listdir(tmp_path / "f")) == ["end", "end2", "start"]
    assert pq.ParquetFile(tmp_path / "f/end2").metadata.num_row_groups == -(-n // 64)
    assert pq.read_table(tmp_path / "f/end")["nation_id"].unique().to_pylist() == [-1]


def test_floor_of_scaled_numbers_is_exact():
    values = [None, 0.0, -1e-9, 1e300, -1e300, float("inf"), float("nan"), 2.5, 1e13, -4.398e12]
    want = [None] + [str(math.floor(v * 1048576)) if math.isfinite(v * 1048576) else str(v) for v in values[1:]]
    assert schema_rewrite.scaled_floor(pa.array(values, pa.float64())).to_pylist() == want
    assert schema_rewrite.scaled_floor(pa.array([1.5, None], pa.float32())).to_pylist() == ["1572864", None]


# ------------------------------------------------------------------ 12


def lloyd(rows, k, rounds, salt="3:"):
    """By brute force, of (id, whole vector)."""
    first = sorted((sha(f"{salt}{i}"), v) for i, v in rows if i is not None)[:k]
    cs = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(cs)):
            if some := [v for (_, v), o in zip(rows, own, strict=True) if o == j]:
                cs[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in rows), key=str), cs


def test_clusters_equal_brute_force_on_odd_vectors(spark):
    r = random.Random(4)
    rows = [(i, [float(r.choice([0, 1, 2, -3])) / 2 for _ in range(4)]) for i in range(120)]  # many ties
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(5, [9.0, 9.0, -9.0, 0.1]), (None, [1.0, 0.0, 0.0, -0.0])]
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 0.0, 0.0]), (304, [float("nan"), 0.0, 0.0, 0.0]), (305, [0.0, float("-inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, `a.b` int")
    want, cs = lloyd(kept, 5, 6)
    for parts in (1, 7):
        out, got = centroids.clusters(df.repartition(parts), 5, 6, dims=4)
        found = out.collect()
        assert got == cs and sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=str) == want
    per = {}
    for _, c, d in want:
        per[c] = per.get(c, 0) + d
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in found} == {(c, s, sum(per.values())) for c, s in per.items()}


def test_clusters_of_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    out, cs = centroids.clusters(df, 8, 3, dims=2)
    assert cs == [[1024, 2048]] * 2 and {r["cluster"] for r in out.collect()} == {0}
    out, cs = centroids.clusters(df.limit(0), 8, 3, dims=2)
    assert cs == [] and out.count() == 0
    empty, digests = centroids.clusters(df, 8, 3, dims=3)
    assert empty.count() == 0 and digests == []


def test_annulus_compares_few_and_keeps_ties():
    r = np.random.default_rng(2)
    scale = np.repeat([10, 100, 1000, 10_000], 16)  # norms far apart
    cs = (r.normal(size=(64, 8)) * scale[:, None]).astype(int).tolist()
    cs[9] = list(cs[40])
    v = np.concatenate([(r.normal(size=(500, 8)) * r.choice(scale, 500)[:, None]).astype(np.int64), np.array(cs, np.int64), np.zeros((1, 8), np.int64)])
    search = centroids.Annuli(cs)
    who, dist, compared = search.nearest(v)
    every = ((v[:, None, :] - np.array(cs)[None]) ** 2).sum(axis=2)
    assert (who == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    assert compared < 0.6 * every.size


def test_large_components_are_exact(spark):
    assert centroids.Annuli([[2**61, 0], [0, 5]]).nearest(np.array([[2**61 - 1, 0], [0, 2**61], [1, 4]]))[0].tolist() == [0, 1, 1]
    df = spark.createDataFrame([(i, [x, 0.5]) for i, x in enumerate((1e30, -1e30, 1e14, 1e14 + 2, 3.0))], "vec_id long, embedding array<double>")
    rows = [(r["id"], list(r["v"])) for r in centroids.whole(df, dims=2).collect()]
    assert rows[0][1][0] == 2**62 and rows[1][1][0] == -(2**62)
    out, cs = centroids.clusters(df, 2, 4, dims=2)
    want, brute = lloyd(rows, 2, 4)
    assert cs == brute and sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=str) == sorted(((i, c, min(d, 2**63 - 1)) for i, c, d in want), key=str)


# ------------------------------------------------------------------ 13


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def odd_texts():
    r = random.Random(6)
    signs = [" ", "  ", "▁", "a", "b", "\n", "\t", "\x00", "e\u0301", "\u00e9", "🎉", "ß", "The", "the", ".", ",", "<s>", "</s>", "<unk>", "<0x41>", "中文", "\u3000", "\u00a0", "\r\n", "\u200b", "\ufffd"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(3000)]
    return [*texts, None, "", " ", "  ", "▁", " ▁ ", "x", "a" * 30_000, "word " * 30_000, " " * 5000, "中" * 5000, "\n" * 1000]


def test_pieces_equal_the_library(spark, library):
    texts = odd_texts()
    df = spark.createDataFrame([(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, ids string").repartition(3)
    coded = pieces.encode(df, id_col="n")
    back = {r["n"]: (r["ids"], r["text"]) for r in pieces.decode(coded, id_col="n").collect()}
    assert len(back) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert back[i] == (ids, library.decode(ids) if ids else ""), t
    both = {r["n"]: (r["ids"], r["again"]) for r in pieces.encode(df, id_col="n", decoded_col="again").collect()}
    assert both == back
    assert pieces.encode(df.limit(0)).count() == 0 and pieces.encode(df).where("doc_id is null").count() == len(texts[::9])


def test_query_of_pieces(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.op13_pieces(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_each_distinct_chunk_is_segmented_once(library, monkeypatch):
    model = pieces.Pieces(pieces.default_model())
    assert model.cut
    asked = []
    real = model.segment
    monkeypatch.setattr(model, "segment", lambda chunks: asked.append(list(chunks)) or real(chunks))
    texts = pa.array(["one two one", "two  three one", None, " two"])
    assert model.ids(texts).to_pylist() == [library.encode(t or "") for t in texts.to_pylist()]
    assert sorted(asked[0]) == sorted(["one", "two", "▁three", "▁two"])  # the words behind their first marker
    model.ids(texts)
    assert asked[1:] in ([], [[]])


def test_a_full_table_forgets_and_long_chunks_stay_out(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_BYTES", 4000)
    model = pieces.Pieces(pieces.default_model())
    r = random.Random(3)
    for _ in range(30):
        texts = [" ".join(str(r.randrange(300)) for _ in range(20)) + " " + "z" * 500 for _ in range(3)]
        assert model.ids(pa.array(texts)).to_pylist() == library.encode(texts)
        assert len(model.known) + len(model.older) < 200 and not any(len(c) > pieces.LONGEST for c in [*model.known, *model.older])


def test_a_model_that_cannot_be_cut_reads_whole_texts(library, monkeypatch):
    monkeypatch.setattr(pieces.Pieces, "_cuttable", lambda self, path: False)
    model = pieces.Pieces(pieces.default_model())
    monkeypatch.setattr(model, "segment", lambda chunks: 1 / 0)
    assert model.ids(pa.array(["a  b", None])).to_pylist() == [library.encode("a  b"), []]


# ------------------------------------------------------------------ bounds on what is learnt from


@pytest.fixture(scope="module")
def hot(spark):
    """One id with 30,000 rows, of which 10,000 are equal, beside ordinary documents; and their labels."""
    some = spark.range(30_000).select(F.lit(12).cast("long").alias("doc_id"), F.concat(F.lit("words of a text "), F.when(F.col("id") < 20_000, F.col("id")).otherwise(0).cast("string")).alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("des mots et d'autres "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "fr").otherwise("en").alias("lang"))
    docs = some.unionByName(rest)
    return docs, docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))


def test_rows_of_one_id_do_not_exceed_the_bounds(spark, hot, monkeypatch):
    docs, labels = hot
    seen = {}
    monkeypatch.setattr(quality_classifier, "fit_rules", lambda columns, y: seen.update(op9=len(y)))
    quality_classifier.train(docs, labels, max_labelled=100)
    monkeypatch.setattr(language_id, "fit_cnn", lambda windows, y, kinds: seen.update(op6=len(y), kinds=kinds))
    language_id.train(docs, docs_per_language=20)
    monkeypatch.setattr(toxicity, "fit_pu", lambda p, u, *more, **named: seen.update(p=len(p), u=len(u)) or (np.zeros(more[-1]), 0.0, []))
    toxicity.train(docs, labels, prior=0.3, max_positive=400, max_unlabelled=800)
    assert seen["op9"] == 100
    assert seen["kinds"] == ["en", "fr"] and 0 < seen["op6"] <= 2 * 20 * language_id.WINDOWS_PER_DOC * 1.5
    assert 200 < seen["p"] <= 440 * 1.2 and 400 < seen["u"] <= 880 * 1.2


# ------------------------------------------------------------------ 3, ids with several texts


def grouped(rows, shingle, similarity):
    """Smallest reachable id by brute force, over equal and similar sets and over the sets of an id."""
    sets = [(i, frozenset(near_dedup.shingle_set(t, shingle).tolist())) for i, t in rows]
    of = {i: i for i, _ in sets}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and len(a & b) >= similarity * len(a | b):
                x, y = sorted((top(i), top(j)))
                of[y] = x
    return {i: top(i) for i in of}


def test_every_text_of_an_id_is_compared(spark):
    r = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    near = lambda t: [*t[:30], "changed", *t[31:]]
    b, base = text(80), [text(60 + k % 50) for k in range(20)]
    rows = [(5, text(300)), (5, b), (7, b), (9, near(b)), (11, text(90)), (11, near(near(b)[::-1])), (12, near(b)[::-1])]
    rows += [(100 + r.randrange(40), base[r.randrange(20)] if r.random() < 0.5 else near(base[r.randrange(20)])) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in rows] + [(5, None), (200, ""), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 6):
        got = near_dedup.link(df.repartition(parts), shingle=3, similarity=0.85).collect()
        assert len(got) == len(rows)
        comp = {x["id"]: x["component_id"] for x in got if x["n_shingles"]}
        want = grouped(rows, 3, 0.85)
        assert comp == {i: want[i] for i in comp} and comp[9] == comp[7] == 5
        assert all(x["component_id"] == x["id"] for x in got if not x["n_shingles"])
