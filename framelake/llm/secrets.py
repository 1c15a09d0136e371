"""Secret scanning through a trigram inverted index, in DataFrame functions only.

1. From each rule's pattern a Boolean trigram query is derived: alternatives of sets of trigrams that every match contains.
2. The index lists, for each trigram that any query needs, the documents whose folded text has it (postings).
3. Postings are intersected: a document with all trigrams of one alternative is a candidate of that rule.
4. Candidates are verified by the pattern itself over the whole text; a rule without mandatory trigrams scans all texts.

Spans come from the pieces between the matches and the matches, both in code points.

Defined results: a null text is empty and has no spans; repeated rows stay, each with its own
spans (rows of one id share candidacy, not results); very long texts are indexed and verified whole; other columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, folder_bytes, let, stage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: whose length must be at least ...
    least: int = 0  #: ... this, after matching


#: The base rules, then those that the method adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED
#: Strings followed at once while a query is derived.
MOST = 64
#: A candidate table of at most this size is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 24 << 20


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    return _least([x | y for x in a for y in b]) if len(a) * len(b) <= 4096 else a


def _least(alternatives: list[frozenset]) -> list[frozenset]:
    """Without alternatives that contain another one."""
    out: list[frozenset] = []
    for x in sorted(set(alternatives), key=lambda s: (len(s), sorted(s))):
        if not any(y <= x for y in out):
            out.append(x)
    return out


ANY = [frozenset()]


def _grams(strings) -> list[frozenset]:
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _derive(tree) -> tuple[set[str] | None, list[frozenset]]:
    """(all strings that the tree matches, or None if too many; alternatives of mandatory trigrams)."""
    known, need = {""}, ANY
    for op, arg in tree:
        strings, own = None, ANY
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(x[0] is sre.LITERAL for x in arg):
            strings = {chr(x[1]).lower() for x in arg}
        elif op is sre.SUBPATTERN:
            strings, own = _derive(arg[-1])
        elif op is sre.BRANCH:
            parts = [_derive(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            own = _least([x for s, n in parts for x in (n if s is None else _grams(s))])
        elif op is sre.MAX_REPEAT:
            low, high, inner = arg
            s, n = _derive(inner)
            if high == 1 and s is not None:
                strings = s | {""}
            elif low == high and s is not None and len(s) ** low <= MOST:
                strings = {"".join(p) for p in itertools.product(s, repeat=low)}
            elif low:
                own = n if s is None else _grams(s)
        if strings is not None and len(strings) * len(known) <= MOST:
            known = {a + b for a in known for b in strings}
        else:
            need = _both(_both(need, _grams(known)), own if strings is None else ANY)
            known = strings if strings is not None and len(strings) <= MOST else {""}
    exact = need == ANY and _finite(tree)
    return (known, ANY) if exact else (None, _both(need, _grams(known)))


def _finite(tree) -> bool:
    """Whether the walk followed every string of the tree."""
    for op, arg in tree:
        if op is sre.IN and not all(x[0] is sre.LITERAL for x in arg):
            return False
        if op is sre.SUBPATTERN and not _finite(arg[-1]):
            return False
        if op is sre.BRANCH and not all(_finite(x) for x in arg[1]):
            return False
        if op is sre.MAX_REPEAT and (arg[1] != 1 and arg[0] != arg[1] or not _finite(arg[2])):
            return False
        if op not in (sre.LITERAL, sre.IN, sre.SUBPATTERN, sre.BRANCH, sre.MAX_REPEAT):
            return False
    return True


def trigram_query(pattern: str) -> list[frozenset]:
    """Alternatives of lower-cased trigrams; [empty set] if a match need have none."""
    strings, need = _derive(list(parser.parse(pattern)))
    return need if strings is None else _grams(strings)


def postings(docs: DataFrame, grams: list[str], key: Column, text: Column) -> DataFrame:
    """(gram, sc_key) of the grams that each row's folded text has; hot grams stay spread, as nothing gathers them by gram."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    has = let(low, lambda t: F.array_compact(F.array(*[F.when(t.contains(g), F.lit(i)) for i, g in enumerate(grams)])))
    names = F.array(*[F.lit(g) for g in grams])
    return docs.select(key.alias("sc_key"), F.explode(has).alias("sc_g")).select(F.get(names, F.col("sc_g")).alias("gram"), "sc_key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(sc_key, sc_rules): rules of which a document has all trigrams of an alternative."""
    spark = index.sparkSession
    clauses = [(g, r.kind, n, len(alt)) for r in rules for n, alt in enumerate(trigram_query(r.pattern)) for g in alt]
    wanted = spark.createDataFrame(clauses, "gram string, sc_kind string, sc_alt int, sc_need int")
    hits = index.distinct().join(F.broadcast(wanted), "gram").groupBy("sc_key", "sc_kind", "sc_alt", "sc_need").agg(F.count(F.lit(1)).alias("sc_n"))  # a row per rule and trigram
    return hits.filter("sc_n = sc_need").groupBy("sc_key").agg(F.collect_set("sc_kind").alias("sc_rules"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end>> of the rule's matches that pass its length test."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    kind = "array<struct<start:int,ord:int,end:int>>"

    def gather(between, hits, values):
        def step(s, i):
            start = s["at"] + F.length(F.get(between, i))
            end = start + F.length(F.get(hits, i))
            span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(F.length(F.get(values, i)) >= rule.least, F.array_append(s["out"], span)).otherwise(s["out"]).cast(kind).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)["out"]

    every = let(F.split(text, rule.pattern, -1), lambda b: let(found, lambda h: let(tested, lambda v: gather(b, h, v))))
    return F.when(text.rlike(rule.pattern), every).otherwise(F.array().cast(kind))


def _listed(found: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, base: int = len(BASE)) -> DataFrame:
    """One row per row of docs: id, n_<kind> for the base kinds, base_sha256, spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(id_col))  # equal hashes share candidacy only
    grams = sorted({g for r in rules for alt in trigram_query(r.pattern) for g in alt})
    index = stage(postings(docs, grams, key, F.col(text_col)), "trigram-index")
    chosen = stage(candidates(index, rules), "secret-candidates")
    rows = docs.select(F.col(id_col).alias("sc_id"), text.alias("sc_text"), key.alias("sc_key"))
    if folder_bytes(docs.sparkSession, chosen) <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    rows = rows.join(chosen, "sc_key", "left")
    found = []
    for n, r in enumerate(rules):
        own = spans(F.col("sc_text"), r, n)
        if trigram_query(r.pattern) != ANY:
            own = F.when(F.array_contains("sc_rules", r.kind), own).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int>>"))
        found.append(own.alias(f"sc_{r.kind}"))
    rows = rows.select("sc_id", *found)
    of = lambda rs: F.concat(*[F.col(f"sc_{r.kind}") for r in rs])
    return rows.select(
        F.col("sc_id").alias(id_col), *[F.size(f"sc_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules[:base]],
        F.sha2(_listed(of(rules[:base]), rules).cast("binary"), 256).alias("base_sha256"), _listed(of(rules), rules).alias("spans"),
    )


def find_secrets_plainly(text: str | None, rules=RULES) -> list[tuple[int, int, str, int]]:
    """Brute force for tests: (start, order, kind, end)."""
    out = []
    for n, r in enumerate(rules):
        out += [(m.start(), n, r.kind, m.end()) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return sorted(out)
