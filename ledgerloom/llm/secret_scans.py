"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regex yields a Boolean query over (case-folded) trigrams: all clauses must hold, a clause holds if one of its
alternatives has all its trigrams. The index holds a posting (trigram, document) for every trigram that some rule asks
for; postings are intersected by grouping, candidates meet their documents in a hash join, and only candidate rules are
run on a text. A rule without a mandatory trigram is run on every text.

Defined cases: a null text counts as empty; null ids and repeated rows keep a row each (the postings of equal ids are
merged, which can only add candidates, and each text is verified by itself); other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `group` and `least` drop matches whose group is shorter than `least`."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
BASE_RULES = (
    Rule("assign", "(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

Clause = frozenset[frozenset[str]]


def trigram_query(regex: str, most: int = 64) -> list[Clause]:
    """Clauses of trigrams (case folded) that every match must satisfy; empty if the regex demands none."""
    import re._constants as c
    import re._parser as parser

    def strings(op, arg) -> set[str] | None:
        """The finite set of folded strings that an item stands for, or None."""
        if op is c.LITERAL:
            return {chr(arg).lower()}
        if op is c.IN and all(o is c.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is c.SUBPATTERN:
            return sequence(arg[3])
        if op is c.BRANCH:
            parts = [sequence(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] is not c.MAXREPEAT and arg[1] <= 8:
            one = sequence(arg[2])
            if one is not None and len(one) ** arg[1] <= most:
                return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        return None

    def sequence(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            one = strings(op, arg)
            if one is None or len(out) * len(one) > most:
                return None
            out = {a + b for a in out for b in one}
        return out

    clauses: list[Clause] = []

    def close(run: set[str]) -> set[str]:
        if min(map(len, run)) >= 3:
            clauses.append(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run))
        return {""}

    def walk(items) -> None:
        run = {""}
        for op, arg in items:
            one = strings(op, arg)
            if one is not None and len(run) * len(one) <= most:
                run = {a + b for a in run for b in one}
            elif one is not None:
                close(run)
                run = one
            else:
                run = close(run)
                if op is c.SUBPATTERN:
                    walk(arg[3])
                elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                    walk(arg[2])
        close(run)

    walk(parser.parse(regex))
    return clauses


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_key, _mask): bit r is set if rule r's trigram query holds for a document with that key."""
    spark = docs.sparkSession
    terms = [
        (r, k, a, t, len(alt))
        for r, rule in enumerate(rules)
        for k, clause in enumerate(trigram_query(rule.regex))
        for a, alt in enumerate(sorted(map(sorted, clause)))
        for t in alt
    ]
    need = [(r, n) for r, rule in enumerate(rules) if (n := len(trigram_query(rule.regex)))]
    grams = sorted({t[3] for t in terms})
    schema = "rule int, clause int, alt int, gram string, size int"
    # Both tables are as large as the rule set, whatever the corpus.
    asked = F.broadcast(spark.createDataFrame(terms, schema))
    clauses = F.broadcast(spark.createDataFrame(need, "rule int, clauses int"))
    found = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("_low"), g))
    postings = docs.select("_key", F.lower("_t").alias("_low")).select("_key", F.explode(found).alias("gram")).distinct()
    alternatives = postings.join(asked, "gram").groupBy("_key", "rule", "clause", "alt", "size").agg(F.count("*").alias("n"))
    held = alternatives.where("n = size").groupBy("_key", "rule").agg(F.count_distinct("clause").alias("n"))
    held = held.join(clauses, "rule").where("n = clauses")
    return held.groupBy("_key").agg(F.sum(F.expr("shiftleft(1L, rule)")).alias("_mask"))


def _spans(text: Column, rule: Rule, order: int) -> tuple[Column, Column, Column]:
    """Columns to apply one after another: matches, gaps before them, spans (start, order, end) that are long enough."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    return found, F.split(text, rule.regex, -1), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))


def _placed(found: Column, gaps: Column, groups: Column, rule: Rule, order: int) -> Column:
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["len"]
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    marks = F.transform(
        found,
        lambda m, i: F.struct(
            F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("len"), (F.char_length(F.get(groups, i)) >= rule.least).alias("keep")
        ),
    )
    return F.aggregate(marks, state, step)["out"]


def _narrow(rule: Rule) -> str:
    """A rule whose whole match must have `least` characters of one class repeats that class so often from the start."""
    m = re.fullmatch(r"([A-Za-z]*)(\[[^\]]+\])\+", rule.regex)
    return f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}" if m and not rule.group and rule.least else rule.regex


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, found (array of (start, kind, end), code points, end exclusive, kind by place in
    `rules`), and the columns named in `keep`."""
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_t"),
        F.xxhash64(id_col, text_col).alias("_key"),  # rows of one key share a mask, which only says what to verify
        *[F.col(k).alias(f"_x_{k}") for k in keep],
    )
    df = df.join(candidates(df, rules).hint("shuffle_hash"), "_key", "left").withColumn("_mask", F.coalesce("_mask", F.lit(0)))
    narrow = [Rule(r.kind, _narrow(r), r.group, r.least) for r in rules]
    whole = [i for i, r in enumerate(rules) if not trigram_query(r.regex)]
    asked = lambda i: F.lit(True) if i in whole else F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0
    df = df.withColumns({f"_m{i}": F.when(asked(i), F.regexp_extract_all("_t", F.lit(r.regex), F.lit(0))) for i, r in enumerate(narrow)})
    some = lambda i: F.size(F.coalesce(F.col(f"_m{i}"), F.array().cast("array<string>"))) > 0
    df = df.withColumns(
        {f"_g{i}": F.when(some(i), F.split("_t", r.regex, -1)) for i, r in enumerate(narrow)}
        | {f"_c{i}": F.when(some(i), F.regexp_extract_all("_t", F.lit(r.regex), F.lit(r.group))) for i, r in enumerate(narrow)}
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    df = df.withColumns({f"_p{i}": F.when(some(i), _placed(F.col(f"_m{i}"), F.col(f"_g{i}"), F.col(f"_c{i}"), r, i)).otherwise(none) for i, r in enumerate(narrow)})
    return df.select("doc_id", F.sort_array(F.concat(*[F.col(f"_p{i}") for i in range(len(rules))])).alias("found"), F.col("_t").alias("text"), *[F.col(f"_x_{k}").alias(k) for k in keep])


def span_list(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """text with each maximal run of overlapping spans replaced by the mask."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    end = F.aggregate(found, state, step)
    return F.when(F.size(found) == 0, text).otherwise(F.concat(end["out"], F.substring(text, end["at"] + 1, F.char_length(text))))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in their texts masked; a null text stays null."""
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    found = scan(packed, keep=("row",))
    text = F.when(F.col("row").getField(text_col).isNotNull(), redacted(F.col("text"), F.col("found"), mask))
    return found.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
