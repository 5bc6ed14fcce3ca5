"""Operators against brute force on small fixtures: nulls, empty, long and repeated texts, ties, clashing columns."""

import collections
import hashlib
import pathlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import chaining, common, decontaminate, licences, packing, quality_rules, repeats, secret_scans, simhash, suffix_tree, toxicity
from ledgerloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, k string, row int"


def words(n, seed):
    r = random.Random(seed)
    return [f"{r.choice(['an', 'be', 'or', 'thi'])}{r.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(words(300, 1))
    texts = [base, base, base.replace(words(300, 1)[150], "changed", 1), None, "", "   ", " ".join(words(8000, 2)), "x" * 600, base[:700] + " " + " ".join(words(60, 3)), "idiot"]
    return spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_repeats(docs):
    raw = {i: (t or "").encode() for i, t in texts_of(docs).items()}
    seen = collections.Counter(r[i : i + 200] for r in raw.values() for i in range(len(r) - 199))
    for row in repeats.deduplicated(docs).collect():
        r = raw[row["doc_id"]]
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        assert (row["n_bytes"], row["n_removed"], hashlib.sha256(row["kept"]).digest()) == (len(r), gone.sum(), hashlib.sha256(kept).digest())


def test_simhash_components(docs):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in texts_of(docs).items()}
    assert {i: r["fp"] & (2**64 - 1) for i, r in found.items()} == fps
    for i in fps:
        reach = {i}
        while more := {b for b in fps for a in reach if (fps[a] ^ fps[b]).bit_count() <= 3} - reach:
            reach |= more
        assert found[i]["component_id"] == min(reach)


def test_deduplication_keeps_a_row_per_component(spark):
    one, two, three, four = (" ".join(words(80, 300 + i)) for i in range(4))
    rows = [(0, one), (1, one), (1, two), (1, two), (2, three), (2, four), (None, three), (None, "alone again"), (None, "alone again")]
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "k", 1) for i, t in given], SCHEMA)
        kept = simhash.deduplicated(docs)
        assert kept.columns == docs.columns
        assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(0, one), (1, two), (2, three), (2, four), (None, "alone again")])


def test_automaton_finds_every_window():
    r = random.Random(5)
    items = [(str(i), [b"abc"[c : c + 1] for c in r.choices(range(3), k=r.randrange(1, 9))]) for i in range(12)]
    auto = decontaminate.Automaton(items, 4)
    for _ in range(200):
        text = [b"abcd"[c : c + 1] for c in r.choices(range(4), k=30)]
        hit, named = set(), set()
        for name, item in items:
            n = min(4, len(item))
            windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
            at = [i for i in range(len(text) - n + 1) if tuple(text[i : i + n]) in windows]
            hit |= {j for i in at for j in range(i, i + n)}
            named |= {name} if at else set()
        spans, got = auto.scan(text)
        assert {j for s, e in spans for j in range(s, e)} == hit
        assert got == named


def test_cut_leaves_other_words():
    assert decontaminate.cut("One TWO three, Four", [(1, 3)]) == "One , Four"
    assert decontaminate.cut("Ünder A b", [(0, 1), (2, 3)]) == " A "


def test_packing_is_gapless(docs):
    found = packing.pack(docs, tokenizer_path(), size=256).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 256
    for i in texts_of(docs):
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in found if r["doc_id"] == i)
        assert sum(n for _, n, _ in mine) == mine[0][2]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(tokenizer_path())
    r = random.Random(7)
    odd = ["It's", "don't.", "a.b.", "x1.", "Émile,", "İx", "ﬁn", "naïve!", "...", "a<|endoftext|>b", "<|ENDOFTEXT|>.", "'s.", "9.", "é", "ǅ.", "Straße?", "e\u0301.", "日本,", "x).", "Ωm;"]
    texts = [None, "", " ", *(" ".join(r.choices(words(50, i) + odd + ["The", "the", "End.", "end"], k=80)) for i in range(40))]
    encoder = packing.Encoder(tokenizer_path(), 2, held=150)
    for _ in range(2):
        got = [x.tolist() for x in encoder.ids(pa.array(texts, pa.string()))]
        assert got == [direct.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_words_of_ascii_letters_skip_what_leaves_them_unchanged(tmp_path):
    """Only other words go through the whole tokenizer; where it changes such words, or has them as tokens of their own, all do."""
    from tokenizers import Tokenizer, normalizers

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.seen = tokenizer, []

        def encode_batch_fast(self, words, **options):
            self.seen += words
            return self.tokenizer.encode_batch_fast(words, **options)

    texts = [" ".join([*words(300, 3), "The", "End.", "x1", "Émile,"]), " ".join(words(300, 4)).translate(str.maketrans("0123456789", "abcdefghij"))]
    encoder = packing.Encoder(tokenizer_path(), 2)
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    got = [x.tolist() for x in encoder.ids(pa.array(texts))]
    direct = Tokenizer.from_file(tokenizer_path())
    assert got == [direct.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    left = {w for t in texts for w in t.lower().split() if not w.strip(".").isascii() or not w.strip(".").isalpha()}
    assert set(" ".join(counting.seen).lower().split()) == {w.strip(",") for w in left}
    changed, added = Tokenizer.from_file(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    changed.normalizer = normalizers.Sequence([normalizers.Lowercase(), normalizers.Replace("th", "z")])
    added.add_tokens(["the"])
    for i, other in enumerate((changed, added)):
        other.save(str(tmp_path / f"{i}.json"))
        encoder = packing.Encoder(str(tmp_path / f"{i}.json"), 2)
        assert encoder.model is None
    assert [x.tolist() for x in packing.Encoder(str(tmp_path / "0.json"), 2).ids(pa.array(["The path thth"]))] == [changed.encode("The path thth", add_special_tokens=False).ids + [2]]


def test_no_exact_run_is_left_without_a_link(spark):
    r = random.Random(11)
    phrases = [words(22, 100 + i) for i in range(12)]
    runs = [words(51, 200 + i) for i in range(6)]
    texts = []
    for i in range(40):
        parts = [r.choice(phrases) if r.random() < 0.6 else words(15, 1000 + 50 * i + j) for j in range(6)]
        parts.insert(r.randrange(7), r.choice(phrases)[:20] + r.choice(runs) if r.random() < 0.6 else [])
        texts.append([w for p in parts for w in p])
    docs = spark.createDataFrame([(i, " ".join(t), "k", 1) for i, t in enumerate(texts)], SCHEMA)
    found = {row["doc_id"]: row["class_id"] for row in chaining.shared_passages(docs).collect()}
    first = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 50):
            assert found[first.setdefault(tuple(t[j : j + 51]), i)] == found[i]


def test_chains_and_passages(docs):
    at = lambda *x: np.array(x)
    assert chaining.chains(at(0, 5, 9), at(2, 7, 11), at(30, 1, 60), at(32, 3, 62), at(12, 12, 12))[0] in ([0, 2], [1, 2])
    found = {r["doc_id"]: r["class_id"] for r in chaining.shared_passages(docs).collect()}
    assert found[0] == found[1] == found[2] == found[8] == 0
    assert found[6] == 6


def words_of(text):
    return (text or "").encode().lower().split()


def brute_passages(texts):
    """Class and shared words of each text, by aligning every pair of whole texts and comparing all windows of 51 words."""
    n = len(texts)
    root, shared, links = list(range(n)), [set() for _ in texts], [set() for _ in texts]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    windows = [{tuple(t[i : i + 51]): i for i in range(len(t) - 50)} for t in texts]
    for i in range(n):
        for j in range(i):
            found = [(s, e, u, v) for s, e, u, v, _ in chaining.align(texts[i], texts[j], 50, 0.8)]
            for w in windows[i].keys() & windows[j].keys():
                found += [(s, s + 51, u, u + 51) for s in range(len(texts[i]) - 50) if tuple(texts[i][s : s + 51]) == w for u in range(len(texts[j]) - 50) if tuple(texts[j][u : u + 51]) == w]
            for s, e, u, v in found:
                shared[i].update(range(s, e))
                shared[j].update(range(u, v))
                links[i].add(j)
                links[j].add(i)
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)], shared, links


def compared(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t), "k", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = sorted(chaining.shared_passages(docs).collect())
    classes, shared, links = brute_passages([words_of(" ".join(t)) for t in texts])
    got = [{w for s, e in row["spans"] for w in range(s, e)} for row in rows]
    return rows, got, classes, shared, links


@pytest.mark.parametrize("gap", [9, 30])
def test_every_passage_of_a_chain(spark, gap):
    new = lambda name, n: [f"{name}{i}" for i in range(n)]
    one, two = new("one", 60), new("two", 55)
    texts = [[*new(f"a{d}", 20), *one, *new(f"b{d}", gap), *two, *new(f"c{d}", 20)] for d in range(2)]
    texts += [[*new("d", 20), *two, *one, *new("e", 20)]]
    rows, got, classes, shared, links = compared(spark, texts)
    assert got == shared and [r["n_links_found"] for r in rows] == [2, 2, 2] and [r["class_id"] for r in rows] == classes
    assert [r["n_shared"] for r in rows] == [115] * 3


def test_passages_whose_parts_are_frequent(spark):
    """Thirds of fuzzy and of exact passages also occur apart in 40 other texts, some of them of one class by another passage."""
    thirds = [words(25, 500 + i) for i in range(6)]
    common = words(60, 77)
    texts = [words(40, 900 + i) + thirds[i % 6] + words(40, 1900 + i) + (common if i % 3 == 0 else []) for i in range(40)]
    fuzzy = thirds[0] + thirds[1] + thirds[2]
    exact = thirds[3] + thirds[4] + thirds[5]
    changed = fuzzy[:37] + ["changed"] + fuzzy[38:]
    texts += [words(30, 41) + fuzzy + words(30, 42), words(30, 43) + changed + words(30, 44)]
    texts += [words(30, 45) + exact + words(30, 46) + common, common + words(30, 47) + exact + words(30, 48)]
    rows, got, classes, shared, links = compared(spark, texts)
    assert got == shared and [r["class_id"] for r in rows] == classes
    assert rows[41]["class_id"] == 40 and rows[40]["n_links_found"] == rows[41]["n_links_found"] == 1
    assert rows[42]["n_shared"] == rows[43]["n_shared"] == 135


def test_fuzzy_passages_whose_seeds_and_distances_are_all_frequent(spark):
    """Two texts share a passage but for a word. All its seeds and pairs of seeds also stand, at its distances, in 102 other texts that hold half of
    it and a few words more, so neither is a first or last holder of any."""
    new = iter(range(10**6))
    fill = lambda n: [f"f{next(new)}" for _ in range(n)]
    texts = []
    for seed in (1, 3, 29, 56):
        p = words(57, seed)
        texts += [[*fill(30), *p[:28], *fill(1), *p[29:], *fill(30)] for _ in range(2)]
        for at in [*range(17)] * 3:
            texts.append([*fill(30), *p[:28], *fill(1 + at), *p[29 + at : 41 + at], *fill(46 - at)])
            texts.append([*fill(30 + at), *p[at : at + 12], *fill(17 - at), *p[29:], *fill(30)])
    docs = spark.createDataFrame([(i, " ".join(t), "k", 1) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: (r["class_id"], r["n_links_found"], [tuple(x) for x in r["spans"]]) for r in chaining.shared_passages(docs).collect()}
    assert found == {i: (i - i % 104 if i % 104 < 2 else i, *((1, [(30, 87)]) if i % 104 < 2 else (0, []))) for i in range(len(texts))}


def test_links_equal_brute_force_on_edited_passages(spark):
    """Recall over all pairs of texts with passages edited word by word: no class is missed, nor a link or a word of small groups."""
    r = random.Random(5)
    base = [words(90, 300 + i) for i in range(8)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(2):
            p = list(r.choice(base))[r.randrange(20) :]
            for _ in range(r.randrange(3)):
                at = r.randrange(len(p))
                p[at : at + r.randrange(2)] = [f"x{r.randrange(10**6)}"] * r.randrange(1, 3)
            parts += words(20, 3000 + r.randrange(10**6)) + p
        texts.append(parts)
    rows, got, classes, shared, links = compared(spark, texts)
    want, have = sum(map(len, shared)), sum(len(a & b) for a, b in zip(got, shared, strict=True))
    assert [row["class_id"] for row in rows] == classes
    assert have >= 0.95 * want and sum(map(len, got)) <= 1.02 * want


def test_copies_and_odd_rows_of_passages(spark):
    text = " ".join(words(60, 9))
    rows = [(1, text, "k", 1), (2, text, "k", 1), (2, text, "k", 1), (None, text, "k", 1), (None, "", "k", 1), (5, None, "k", 1), (6, "a b", "k", 1), (7, text.upper() + " end", "k", 1)]
    found = sorted(map(tuple, chaining.shared_passages(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    whole = [r for r in found if r[4]]
    assert len(found) == 8 and all(r[1] == 1 for r in whole) and sorted(str(r[0]) for r in whole) == ["1", "2", "2", "7", "None"]
    assert {r[2] for r in whole if r[0] != 7} == {2} and {r[3] for r in whole} == {1} and {r[4] for r in whole} == {60}


def test_rules_and_secrets(spark):
    text = "Read more\n" + " ".join(words(80, 4)) + ".\npassword = 'hunter2222'"
    docs = spark.createDataFrame([(1, text, "k", 1), (2, None, "k", 1), (3, "", "k", 1)], SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.assess(docs).collect()}
    assert kept == {1: True, 2: False, 3: False}
    assert quality_rules.cleaned(docs).columns == docs.columns
    masked = {r["doc_id"]: r["text"] for r in secret_scans.masked(docs).collect()}
    assert "hunter2222" not in masked[1] and "[SECRET]" in masked[1] and masked[2] is None


def test_licences(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n" + licences.TEXTS["MIT"].upper().replace("SUBLICENSE", "sub-licence")
    isc = licences.TEXTS["ISC"].replace("that the above copyright", "that the above\ncopyright")  # the rest of a sentence, no copyright line
    bsd = "BSD 3-Clause License\n\n© Someone\nAll rights reserved.\n" + licences.TEXTS["BSD-3-Clause"].replace("copyright holder ", "copyright owner ")
    rows = [mit, None, "text\nReleased under the MIT Licence!\nLicensed under CC BY 4.0", isc, bsd, "", "Released under the MIT Licence!", licences.TEXTS["MIT"] + " and more"]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(rows)] + [(None, mit, "k", 1)] * 2, SCHEMA)
    found = sorted(((r["doc_id"], r["licence"], list(r["notices"])) for r in licences.scan(docs).collect()), key=str)
    whole = {0: "MIT", 3: "ISC", 4: "BSD-3-Clause", 6: "MIT"}
    assert found == sorted([(i, whole.get(i), {2: ["CC-BY-4.0", "MIT"], 6: ["MIT"]}.get(i, [])) for i in range(8)] + [(None, "MIT", [])] * 2, key=str)
    nothing = licences.scan(docs, known=spark.createDataFrame([], "digest string, licence string")).collect()
    assert len(nothing) == 10 and not any(r["licence"] or r["notices"] for r in nothing)
    one = hashlib.sha256(licences.canonical_text("Licensed under CC BY 4.0").encode()).hexdigest()
    own = licences.scan(docs, known=spark.createDataFrame([(one, "mine"), (one, "mine")], "digest string, licence string")).collect()
    assert [(r["doc_id"], list(r["notices"])) for r in own if r["notices"]] == [(2, ["mine"])]


def test_whole_licence_files(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    files = [f for f in names if (folder / f).exists()]
    if not files:
        pytest.skip("no licence files here")
    docs = spark.createDataFrame([(i, " \n".join((folder / f).read_text().upper().split("\n")), "k", 1) for i, f in enumerate(files)], SCHEMA)
    assert {r["doc_id"]: r["licence"] for r in licences.scan(docs).collect()} == {i: names[f] for i, f in enumerate(files)}


def symbols_of(text):
    """(context, symbol) of every symbol of a text with how often it occurs, by the definition."""
    all_words = [w.lower() for w in (text or "").encode().split()]
    pairs = collections.Counter(zip([b"", *((b" " + w)[-3:] for w in all_words)], [*all_words, None]))
    for (before, w), n in pairs.items():
        if w is None:
            yield before + b" ", 0x0A, n
            continue
        spelled = b" " + w + b" "
        for j in range(1, len(spelled)):
            yield (before if j < 3 else b"") + spelled[:j] if j < 3 else spelled[max(j - 6, 0) : j], spelled[j], n


def test_scores_equal_a_tree_that_grows_with_the_corpus(spark):
    # So many symbols that a share of 1e-6 of them is over the counts of the rare words' contexts.
    r = random.Random(17)
    rare = ["zyxwvutsr", "qqkkjjhh", "ünïcødé", "xx", "y"]
    texts = ["common " * 900_000, *(" ".join(r.choices(rare + words(20, 18), k=12)) for _ in range(24)), None, ""]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], SCHEMA)
    found = {row["doc_id"]: row for row in suffix_tree.score(docs).collect()}
    assert not found[0]["held_out"] and any(row["held_out"] for row in found.values())
    counts = collections.defaultdict(collections.Counter)
    for i, t in enumerate(texts):
        for context, symbol, n in symbols_of(t) if not found[i]["held_out"] else ():
            for d in range(len(context) + 1):
                counts[context[len(context) - d :]][symbol] += n

    def prob(context, symbol):
        parent = prob(context[1:], symbol) if context else 1 / 256
        return smoothed(context, symbol, parent) if retained(context) else parent

    def smoothed(context, symbol, parent):
        c = counts[context]
        return (c[symbol] + len(c) * parent) / (c.total() + len(c))

    kept = {b"": True}

    def retained(context):
        if context not in kept:
            c = dict(counts[context]) if context in counts else {}
            total = sum(c.values())
            kept[context] = total >= 2 and sum(n * np.log(n / total / prob(context[1:], s)) for s, n in c.items()) >= 4.0
            counts[context] = collections.Counter(c)
        return kept[context]

    for i, t in enumerate(texts):
        assert found[i]["score"] == pytest.approx(sum(n * np.log10(prob(c, s)) for c, s, n in symbols_of(t)), rel=1e-9)


def test_segments():
    m = toxicity.Model({}, 0.5, 1.0)
    assert m.segments([2, 3, 20], [2.0, 1.0, 4.0]) == [(3.0, 2, 3), (4.0, 20, 20)]


def test_models_without_rows(empty, docs, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.detect(docs, labels).collect()} == {0.0}
    assert suffix_tree.score(docs).count() == docs.count()


def test_empty_tables(empty, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (quality_rules.cleaned(empty), secret_scans.masked(empty), licences.scan(empty), simhash.deduplicated(empty), decontaminate.clean(empty, items), packing.pack(empty, tokenizer_path()), repeats.deduplicated(empty), chaining.shared_passages(empty), suffix_tree.score(empty)):
        assert out.count() == 0


def test_repeats_merge_only_grams_with_stretches_met_once(spark, monkeypatch):
    """Copies cover all their windows, so no bytes of theirs are compared; near copies of texts met once are, as equals of brute force."""
    asked = []
    contents = repeats._contents
    monkeypatch.setattr(repeats, "_contents", lambda docs, wanted, width: asked.append(wanted.count()) or contents(docs, wanted, width))
    r = np.random.default_rng(3)
    base = bytes(r.integers(97, 122, 900).astype(np.uint8)).decode()
    near = base[:450] + "#" + base[451:]
    for texts, several in (([base, near] * 2, False), ([base, near], True)):
        raw = [t.encode() for t in texts]
        seen = collections.Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
        gone = {i: sum(any(seen[x[j : j + 200]] > 1 for j in range(max(0, at - 199), min(at, len(x) - 200) + 1)) for at in range(len(x))) for i, x in enumerate(raw)}
        found = repeats.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert {x["doc_id"]: x["n_removed"] for x in found.collect()} == gone and (asked.pop() > 0) is several


def test_refined_windows_equal_a_plain_count():
    """Intervals of two, of many, and such that part at every step."""
    r = np.random.default_rng(4)
    raw = bytes(r.integers(97, 99, 60).astype(np.uint8)) * 3 + bytes(r.integers(97, 99, 400).astype(np.uint8)) + b"c" * 60
    starts = np.arange(len(raw) - 16)
    block = r.integers(0, 3, len(starts)) * 10**12
    seen = collections.Counter((b, raw[s : s + 16]) for b, s in zip(block.tolist(), starts.tolist(), strict=True))
    expected = [seen[b, raw[s : s + 16]] > 1 for b, s in zip(block.tolist(), starts.tolist(), strict=True)]
    assert repeats.refined(raw, starts, block, 16).tolist() == expected and 0 < sum(expected) < len(expected)


def test_windows_of_many_units_come_together():
    """A batch of units gives one batch of windows, whatever their number: digests, places and whether the unit is met once."""
    data = [bytes(range(i, i + 200 + i % 8)) if i < 40 else b"x" * 200 for i in range(50)]
    units = pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array([i % 2 == 0 for i in range(50)]), pa.array(range(50), pa.int64()), pa.array(range(0, 500, 10), pa.int64())], ["data", "once", "k", "start"])
    (got,) = repeats._windows([units], 200)
    plain = [(xxhash.xxh3_128_intdigest(d[j : j + 200]), i, 10 * i + j, i % 2 == 0) for i, d in enumerate(data) for j in range(len(d) - 199)]
    halves = [(a % 2**64) << 64 | b % 2**64 for a, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)]
    assert list(zip(halves, *(got.column(c).to_pylist() for c in ("k", "start", "once")), strict=True)) == plain


def test_written_tables_leave_no_shuffle_files_and_scratch_ones_go(spark, docs):
    """The session's setting is as before; what a table is kept from goes at the end of its scratch, and so do kept ones at the end of an outer one."""
    local = pathlib.Path(spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: {p for p in local.rglob("shuffle_*.data")}
    there = lambda df: pathlib.Path(df.written_to.removeprefix("file://")).exists()
    before, was = files(), spark.conf.get(common._CLEANUP, None)
    with common.scratch() as outer:
        with common.scratch() as inner:
            gone = common.written(spark.range(100).groupBy((F.col("id") % 7).alias("x")).count(), "gone")
            kept = inner(common.written(gone.select("x"), "kept"))
            last = inner(outer(common.written(gone.where("x < 3"), "last")))
        assert not there(gone) and there(kept) and there(last)
    assert not there(kept) and there(last) and len(last.collect()) == 3 and spark.conf.get(common._CLEANUP, None) == was
    for _ in range(100):  # the files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_passages_leave_only_tables_that_their_rows_need(spark, docs, monkeypatch):
    made = []
    written = chaining.written
    monkeypatch.setattr(chaining, "written", lambda df, name: made.append((name, written(df, name))) or made[-1][1])
    found = chaining.shared_passages(docs)
    left = {name for name, df in made if pathlib.Path(df.written_to.removeprefix("file://")).exists()}
    assert len(found.collect()) == docs.count()
    assert not left & {"seeds", "shared-seeds", "counted-seeds", "seed-pairs", "needed-texts", "windows", "open-texts", "open-chains", "rare-shingles"} and "known" in left


def test_a_slice_without_words_has_no_runs(monkeypatch):
    """Also as the first one that a worker meets, before any powers are known."""
    monkeypatch.setattr(chaining, "_powers", {})
    assert len(chaining.Words(pa.array([None, "", " "])).runs(chaining.SEED)) == 0
