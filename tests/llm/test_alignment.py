"""Cross-tokenizer alignment against whole texts tokenized directly, in plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import alignment
from ledgerloom.llm.queries import ALIGNED, tokenizer_path

PATHS = tuple(map(tokenizer_path, ALIGNED))
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000\x1c\x1f\u200b\ufeff\u180e"


@pytest.fixture(scope="module")
def both():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def brute(texts, both):
    """Rows of the contract, by overlaps of all token ranges of each text."""
    a, b = both
    marks = alignment._bytes_of_marks()
    rows, counts = [], Counter()
    for text in texts:
        spaced = " " + (text or "")
        x, y = a.encode(spaced, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        of_x = [bytes(marks[c] for c in a.id_to_token(i)) for i in x]
        of_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(of_x) != spaced.encode() or b"".join(of_y) != spaced.encode():
            rows.append(None)
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
        ex, ey = ends(of_x), ends(of_y)
        links, j = [], 0
        for i, e in enumerate(ex):
            while j < len(ey) and ey[j] <= e - len(of_x[i]):
                j += 1
            k = j
            while k < len(ey) and ey[k] - len(of_y[k]) < e:
                links.append((x[i], y[k]))
                k += 1
        groups, p, q = [], 0, 0
        for e in sorted(set(ex) & set(ey)):
            i, k = ex.index(e) + 1, ey.index(e) + 1
            groups.append(",".join(map(str, x[p:i])) + "|" + ",".join(map(str, y[q:k])))
            p, q = i, k
        rows.append((len(x), len(y), groups, links))
        counts.update(links)
    best: dict[int, int] = {}
    for (_, k), n in counts.items():
        best[k] = max(best.get(k, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = r
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def _texts():
    rng = random.Random(5)
    words = ["the", "naïve", "Straße", "don't", "we'll", "x9", "3.14", "日本語", "привет", "éte", "ﬁ", "🙂", "à", "<s>", "<|endoftext|>", "<0x41>", "ǅ", "ª", "_", "--", "C++", "p=1;", "\x00", "ɐ", "·", "İ"]
    texts = ["", None, " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n a", "the the the.", "holds ▁ blank", "▁", "x" * 3000, "the cat. " * 400, "中" * 300, "word\t word \n word\r\n\r\n  word"]
    for _ in range(150):
        texts.append("".join(rng.choice(words) + "".join(rng.choice(SPACES if rng.random() < 0.3 else " ") for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))) for _ in range(rng.randrange(1, 40))))
        texts.append("".join(rng.choice(SPACES + "aé1.,'\"я字") for _ in range(rng.randrange(1, 30))))
    return texts + texts[40:60]


@pytest.fixture(scope="module")
def given(spark):
    rows = [(i, t, "k", 1.0, i % 3) for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, unit string, n double, u int").repartition(4)


def test_units_are_tokenized_as_in_their_texts(both):
    """Cuts fall where neither tokenizer joins what stands on both sides."""
    cutter = alignment.Cutter(*PATHS)
    assert cutter.local and cutter.plain
    for text in _texts():
        if cutter.kept(text):
            units = cutter.units(" " + text)
            assert "".join(units) == " " + text
            a, b = cutter.tokens(units)
            assert [i for x in a for i in x] == both[0].encode(" " + text, add_special_tokens=False).ids
            assert [i for x in b for i in x] == both[1].encode(text)


@pytest.mark.parametrize(("hot", "whole"), [(1 << 18, False), (6, False), (0, False), (1 << 18, True)])
def test_alignment_equals_brute_force(given, both, hot, whole):
    """All units broadcast, a few, none; and whole texts as units."""
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(given, *PATHS, hot=hot, whole=whole).select("doc_id", *alignment.SUMS, "groups_sha256").collect()}
    assert [got[i] for i in range(len(got))] == brute(_texts(), both)


def test_alignment_of_null_ids_and_empty_tables(spark, both):
    rows = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None)], "doc_id long, text string")
    one = brute(["one two", "one two"], both)[0]
    got = [tuple(r) for r in alignment.align(rows, *PATHS).select("doc_id", *alignment.SUMS, "groups_sha256").collect()]
    assert sorted(got, key=str) == sorted([(None, *one), (None, *one), (1, 0, 0, 0, 0, 0, 0, "")], key=str)
    assert alignment.align(rows.where("doc_id = 7"), *PATHS).collect() == []
