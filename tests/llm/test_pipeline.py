"""The pipeline from documents to packed sequences, and packing, toxicity and language model scores against plain Python."""

import random
import zlib

import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import packing, quality_rules, toxicity
from ledgerloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(f"{r.choice(['wor', 'lat', 'mun', 'tes'])}{r.choice(['da', 'li', 'no', 're'])}{r.choice(['ra', 'so', 'ti'])}" + ("." if i % 9 == 8 else "") for i in range(n))


def fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    if not grams:
        return 0
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, prose(40, 99)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    secret = prose(80, 5) + " password = hunter2hunter2 " + prose(80, 6)
    rows = [(i, prose(150 + 40 * i, i)) for i in range(8)]
    rows += [(20, rows[3][1]), (21, rows[3][1] + " extra"), (22, rows[3][1]), (None, rows[3][1]), (None, prose(160, 77)), (30, prose(30, 3)), (31, None), (32, "")]
    rows += [(40, prose(60, 8) + " " + prose(40, 99)), (41, secret), (42, secret + " " + prose(60, 12)), (43, prose(9000, 13)), (44, prose(200, 14)), (44, prose(200, 14))]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages_against_plain_python(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    kept = stages["quality"](spark, docs, path)
    assert kept.columns == columns
    verdicts = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.assess(docs).collect()}
    want = sorted(str(k) for k, t in rows if verdicts[k, len((t or "").split())])
    first = kept.collect()
    assert sorted(str(r["doc_id"]) for r in first) == want and not {"30", "31", "32"} & set(want)
    one = stages["near_duplicates"](spark, kept, path).collect()
    prints = sorted({fingerprint(r["text"]) for r in first})
    root = {p: p for p in prints}
    for a in prints:  # smallest print of each component, by spreading
        todo = [a]
        while todo:
            x = todo.pop()
            for y in prints:
                if (x ^ y).bit_count() <= 3 and root[y] > root[a]:
                    root[y] = root[a]
                    todo.append(y)
    groups = {}
    for r in first:
        groups.setdefault(root[fingerprint(r["text"])], []).append(r["doc_id"])
    least = sorted(str(min(g, key=lambda k: (k is None, k or 0))) for g in groups.values())
    assert sorted(str(r["doc_id"]) for r in one) == least and len(one) < len(first)
    clean = stages["decontamination"](spark, spark.createDataFrame(one, kept.schema), path).collect()
    assert {r["doc_id"] for r in one} - {r["doc_id"] for r in clean} == {40}
    masked = stages["secrets"](spark, spark.createDataFrame(clean, kept.schema), path).collect()
    before = {r["doc_id"]: r["text"] for r in clean}
    for r in masked:
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] if r["doc_id"] not in (41, 42) else "hunter2" not in r["text"]
    assert len(masked) == len(clean) and all(x in {r["doc_id"] for r in masked} for x in (0, 43))
    pieces(spark, spark.createDataFrame(masked, kept.schema), stages["packing"](spark, spark.createDataFrame(masked, kept.schema), path))


def pieces(spark, docs, packed):
    """Every id of every document is in one piece, by direct tokenizing; pieces fill sequences from zero without gaps."""
    direct = Tokenizer.from_file(tokenizer_path())
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append(direct.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    rows, places = packed.collect(), {}
    for r in rows:
        options = [x[r["start"] : r["start"] + r["length"]] for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert r["ids_crc32"] in {zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x)) for x in options} and r["length"] > 0
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    for k, lists in ids.items():
        got = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == k)
        assert sum(n for _, n in got) == sum(map(len, lists))
        if len(lists) == 1:
            assert [s for s, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))]
    return places, sum(len(x) for lists in ids.values() for x in lists)


def test_run_equals_its_stages(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    found = out.collect()
    assert {r["doc_id"] for r in found} >= {0, 1, 43} and not {20, 21, 22, 30, 31, 32, 40} & {r["doc_id"] for r in found}


def test_packing_against_direct_tokenizing(spark):
    """Ties in length, repeated rows of one id, null ids and texts, a document longer than a sequence."""
    rows = [(i, prose(50, i % 3)) for i in range(30)] + [(1, prose(50, 1)), (None, prose(20, 4)), (None, None), (50, ""), (51, prose(9000, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places, total = pieces(spark, docs, packing.pack(docs, tokenizer_path()))
    assert len(places) * 4096 >= total and len(places) <= -(-total // 4096) + 1


def test_toxicity_tells_held_out_documents_apart(spark):
    """Toxic words in a third of documents; a plain log-odds of the same words gives the ranking to match."""
    r = random.Random(4)
    bad = ["vilexo", "grunda", "zarkil"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = prose(60, i).split()
        for _ in range(8 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        if i % 10:
            labels += [(i, int(toxic))] * (2 if i % 11 == 0 else 1)
    labels += [(None, 1), (5, None)]
    rows += [(None, "vilexo grunda zarkil vilexo grunda"), (2000, ""), (2001, None)]
    found = toxicity.detect(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= x["score"] <= 1 for x in found)
    held = {x["doc_id"]: x for x in found if x["held_out"]}
    assert set(held) == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(x["predicted"] == int(i < 900 and i % 3 == 0) for i, x in held.items())
    score = {x["doc_id"]: x["score"] for x in found}
    assert score[None] > max(score[2000], score[2001])


def test_toxicity_ranks_held_out_documents_with_few_labels(spark):
    """With a dozen toxic texts no word is sure enough for a segment; their held-out ones still come first."""
    r = random.Random(5)
    bad = ["scoria", "vilely", "trawsh", "idjits", "clound", "mugger", "pestle", "wretch"]
    rows = [(i, " ".join([f"word{r.randrange(40)}" for _ in range(30)] + (r.sample(bad, 2) if i % 6 == 0 else []))) for i in range(72)]
    labels = [(i, int(i % 6 == 0)) for i in range(72)]
    found = toxicity.detect(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(x["score"], x["doc_id"] % 6 == 0) for x in found.where("held_out").collect()]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    pairs = [(a > b) + 0.5 * (a == b) for a in toxic for b in clean]
    assert pairs and sum(pairs) / len(pairs) > 0.9


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """More labels than are sent along train all the same, each of a text of its own."""
    n = 260_000
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    docs = ids.selectExpr("doc_id", "concat('word', doc_id, ' and more') AS text")
    counted = []
    monkeypatch.setattr(toxicity, "feature_counts", lambda labelled: counted.append(labelled.groupBy("toxic").count().collect()))
    monkeypatch.setattr(toxicity, "learn", lambda *_, **__: None)
    toxicity.detect(docs, ids.selectExpr("doc_id", "cast(doc_id % 3 = 0 AS int) AS toxic"))
    train = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 not in (0, toxicity.CALIBRATION_FOLD)]
    assert dict(map(tuple, counted[0])) == {1: sum(i % 3 == 0 for i in train), 0: sum(i % 3 != 0 for i in train)}


def test_toxicity_of_dealt_labels_equals_that_of_sent_ones(spark):
    rows = [(i, prose(40, i % 150) + (" vilexo grunda zarkil" if i % 3 == 0 else "")) for i in range(400)] + [(None, "vilexo"), (7, "grunda"), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    sent, dealt = (sorted(map(repr, toxicity.detect(docs, labels, send_rows=most).collect())) for most in (200, 199))
    assert sent == dealt and len(sent) == len(rows)
