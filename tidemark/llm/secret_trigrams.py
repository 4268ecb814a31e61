"""Secret scanning with a trigram inverted index, in DataFrame expressions only.

From each rule's regex a Boolean query over trigrams is derived: AND over runs of literals, OR over the alternatives of a run. An inverted
index maps each trigram that some query needs to blocks of sorted-out document ids; the queries intersect and unite those lists, and only
the documents that remain are verified with the regex. A rule without a mandatory trigram (the hex rule) scans every text.

Verification uses equivalent forms that match less often where a rule's minimum length allows: maximal runs of a class with at least n
characters are the runs found by `+` and dropped if shorter. The assignment rule keeps its exact form, for there a dropped match uses up text.

Null texts count as empty; documents without an id are verified against every rule; repeated ids are verified as separate rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import own_names

try:
    from re import _constants as sc
    from re import _parser as sp
except ImportError:  # before Python 3.11
    import sre_constants as sc
    import sre_parse as sp


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    #: Characters that the group must have at least; shorter matches use up text but are dropped.
    least: int = 0


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [Rule("assign", ASSIGN, 2, 6), Rule("access", r"AKIA[A-Z0-9]{16,}"), Rule("hex", r"[0-9a-f]{24,}")]
#: Published shapes of tokens.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
RULES = BASE + MORE
#: Alternatives of one literal run that are told apart; a run with more ends there.
WIDEST = 64
#: Document ids of one posting list.
BLOCK = 1024


def _literals(node) -> set[str] | None:
    """The lower-cased strings that a parsed element can match if they are few and known, else None."""
    op, arg = node
    if op is sc.LITERAL:
        return {chr(arg).lower()}
    if op is sc.IN and all(o in (sc.LITERAL, sc.RANGE) for o, _ in arg):
        chars = [chr(c).lower() for o, a in arg for c in ([a] if o is sc.LITERAL else range(a[0], a[1] + 1))]
        return set(chars) if len(set(chars)) <= 8 else None
    if op is sc.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sc.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(x is None for x in parts) else set().union(*parts)
    if op is sc.MAX_REPEAT and arg[1] <= 4 and (inner := _sequence(arg[2])) is not None:
        out: set[str] = set()
        for n in range(arg[0], arg[1] + 1):
            out |= reduce(lambda a, _: {x + y for x in a for y in inner}, range(n), {""})
        return out if len(out) <= WIDEST else None
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _literals(node)
        if more is None or len(out) * len(more) > WIDEST:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(regex: str) -> list[list[list[str]]]:
    """AND of runs, each an OR of alternatives, each an AND of trigrams; [] if nothing is mandatory."""
    runs, run = [], {""}

    def close(run: set[str]) -> None:
        if run and all(len(x) >= 3 for x in run):
            sets = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run}
            runs.append(sorted(tuple(sorted(a)) for a in sets if not any(b < a for b in sets)))  # what implies another alternative adds nothing

    for node in sp.parse(regex):
        more = _literals(node)
        if more is None or len(run) * len(more) > WIDEST:
            close(run)
            run = {""}
            if more is None and node[0] is sc.MAX_REPEAT and node[1][0] >= 1:  # at least one of them follows: a mandatory part may stand inside
                inner = _sequence(node[1][2])
                run = inner if inner is not None and len(inner) <= WIDEST else {""}
                close(run)
                run = {""}
            elif more is not None:
                run = more
            continue
        run = {a + b for a in run for b in more}
    close(run)
    return [[list(x) for x in r] for r in runs]


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(trigram, block, ids): in each text, the wanted trigrams that it holds; ids of one block of the id space form one list."""
    low = F.lower(text_col)
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    rows = docs.select(F.col(id_col).alias("id"), low.alias("low")).where("id is not null").select("id", F.explode(held).alias("trigram"))
    return rows.groupBy("trigram", F.floor(F.col("id") / block).alias("block")).agg(F.collect_set("id").alias("ids"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, kinds): for each document the rules whose trigram query its posting lists satisfy."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    none = F.array().cast(index.schema["ids"].dataType)
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)
    both, either = F.array_intersect, F.array_union
    per_rule = []
    for rule in rules:
        if query := trigram_query(rule.regex):
            ids = reduce(both, [reduce(either, [reduce(both, map(of, alternative)) for alternative in run]) for run in query])
            per_rule.append(F.struct(F.lit(rule.kind).alias("kind"), ids.alias("ids")))
    hits = lists.select(F.explode(F.array(*per_rule)).alias("hit")).select("hit.kind", F.explode("hit.ids").alias("id"))
    return hits.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """(start, order, end, kind) of each kept match in code points: the texts between the matches and the matches themselves add up to the places."""
    regex = F.lit(rule.regex)
    gaps = F.split(text, rule.regex, -1)
    wholes = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else wholes
    steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(wholes)), wholes, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("hit"))), parts, lambda s, p: F.struct(s.gap.alias("gap"), s.hit.alias("hit"), F.length(p).alias("part")))
    span = "struct<start:int,order:int,end:int,kind:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first, end = acc.at + x.gap, acc.at + x.gap + x.hit
        one = F.struct(first.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x.part >= rule.least, F.concat(acc.spans, F.array(one))).otherwise(acc.spans).alias("spans"))

    return F.aggregate(steps, start, step, lambda acc: acc.spans)


@own_names
def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with `__found` (a column of that name gives way): the spans (start, order, end, kind) of all rules in order of start, then of the rules."""
    rules = RULES if rules is None else rules
    indexed = [r for r in rules if trigram_query(r.regex)]
    wanted = sorted({t for r in indexed for run in trigram_query(r.regex) for alternative in run for t in alternative})
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    if indexed:
        found = candidates(postings(docs, wanted, id_col, text_col), indexed).select(F.col("id").alias("__id"), F.col("kinds").alias("__kinds"))
        rows = rows.join(found, F.col(id_col) == F.col("__id"), "left").drop("__id")
    else:
        rows = rows.withColumn("__kinds", F.lit(None).cast("array<string>"))
    each = []
    for order, rule in enumerate(rules):
        may = F.col("__text").rlike(rule.regex)
        if rule in indexed:
            may = (F.array_contains("__kinds", rule.kind) | F.col(id_col).isNull()) & may
        each.append(F.when(may, _spans(rule, order, F.col("__text"))).otherwise(none))
    return rows.withColumn("__found", F.array_sort(F.concat(*each))).drop("__text", "__kinds")


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@own_names
def redact(docs: DataFrame, mask: str = "[secret]", rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by the mask; spans that overlap are replaced as one. Columns are those of docs; nulls stay null."""
    found = scan(docs, rules, id_col, text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        past = F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out"))
        fresh = F.struct(s.end.alias("at"), F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit(mask)).alias("out"))
        return F.when(s.start < acc.at, past).otherwise(fresh)

    clean = F.aggregate("__found", start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text) - acc.at)))
    return found.withColumn(text_col, F.when(F.size("__found") > 0, clean).otherwise(text)).select(*docs.columns)
