"""Secret scans with a trigram inverted index, in DataFrame functions alone.

Each rule's regex gives a Boolean query over trigrams that every match must hold
(case folded).  The index has, for each block of about 4096 ids, a posting list of
each trigram that some query uses; a block's lists are intersected and united as the
query says, and only candidates are verified with the regex.  A rule without mandatory
trigrams scans every text.

The candidates (ids and a bit for each rule) are written, counted, and broadcast if they are LISTED
rows at most, so no text is shuffled; beyond that only texts that hold all trigrams of
some query are joined by id, and all others stay where they are.

Only base rules decide n_assign, n_access, n_hex and base_spans; the other rules add
spans.  Positions are code points, end exclusive.

Defined results: a null text is empty and has no spans; rows with a null id are
verified without the index; repeated ids share postings and are verified each by its
own text; empty tables work; other columns, whatever their names, stay as they are, but
a column named as the result of secrets() (`to`) is replaced.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.cluster import Scratch, free_names

#: Rows of one index block, about; candidates that are broadcast at most; matches that one inner array grows by.
BLOCK_IDS, LISTED, CHUNK = 4096, 1 << 20, 256
MASK = "[redacted]"


@dataclass(frozen=True)
class Rule:
    """Matches of `regex` whose group has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules and well-known public key formats.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query is True (no demand), a trigram, or ("and" | "or", its parts).
Query = bool | str | tuple
_MOST = 64


def _join(kind: str, parts: list[Query]) -> Query:
    flat = list(dict.fromkeys(q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == kind else (p,))))
    if kind == "and":
        flat = [q for q in flat if q is not True]
    elif True in flat:
        return True
    if not flat:
        return True
    if kind == "or":  # a choice that demands all that another demands, and more, adds nothing
        sets = [frozenset(q[1]) if isinstance(q, tuple) else frozenset((q,)) for q in flat]
        flat = [q for q, own in zip(flat, sets, strict=True) if not any(other < own for other in sets)]
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _needs(strings: set[str]) -> Query:
    """Some of these strings occurs, so all trigrams of some of them do."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else True


def _cross(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x, y in product(a, b)} if len(a) * len(b) <= _MOST else None


def _strings(items) -> tuple[set[str] | None, Query]:
    """All strings that a pattern matches, if few; and what it demands besides."""
    runs: set[str] = {""}
    query: list[Query] = []
    exact = True

    def flush() -> None:
        nonlocal runs
        query.append(_needs(runs))
        runs = {""}

    for op, arg in items:
        own: set[str] | None = None
        demand: Query = True
        if op is sre.LITERAL:
            own = {chr(arg).lower()}
        elif op is sre.IN:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
                else:
                    chars = set()
                    break
            own = chars if 0 < len(chars) <= 8 else None
        elif op is sre.SUBPATTERN:
            own, demand = _strings(arg[-1])
        elif op is sre.BRANCH:
            each = [_strings(x) for x in arg[1]]
            own = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
            demand = True if own is not None else _join("or", [_join("and", [q, _needs(s) if s is not None else True]) for s, q in each])
        elif op is sre.MAX_REPEAT:
            low, high, what = arg
            one, inner = _strings(what)
            if high == 1 and low == 0 and one is not None:
                own = one | {""}
            elif low == high == 1 and one is not None:
                own = one
            elif low >= 1:
                demand = _join("and", [inner, _needs(one) if one is not None else True])
        wider = _cross(runs, own) if own is not None else None
        if wider is None:
            flush()
            exact = False
            if own is not None:
                runs = own
        else:
            runs = wider
        query.append(demand)
    if exact:
        return runs, _join("and", query)
    flush()
    return None, _join("and", query)


def trigram_query(regex: str) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match satisfies."""
    own, query = _strings(list(parser.parse(regex)))
    return _join("and", [query, _needs(own) if own is not None else True])


def _trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(_trigrams, q[1]))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(id, flags): bit r is set if the index has the document for rule r."""
    queries = {r: trigram_query(x.regex) for r, x in enumerate(rules)}
    queries = {r: q for r, q in queries.items() if q is not True}
    names = {t: f"t{k}" for k, t in enumerate(sorted(set().union(*map(_trigrams, queries.values()))))}
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    block = F.pmod(F.xxhash64("id"), F.lit(-(-docs.count() // BLOCK_IDS) or 1)).alias("block")
    held = low.select("id", block, *(F.contains("low", F.lit(t)).alias(n) for t, n in names.items()))
    postings = held.groupBy("block").agg(*(F.collect_set(F.when(F.col(n), F.col("id"))).alias(n) for n in names.values()))

    def run(q: Query) -> Column:
        if isinstance(q, str):
            return F.col(names[q])
        return reduce(F.array_intersect if q[0] == "and" else F.array_union, map(run, q[1]))

    def flagged(r: int, q: Query) -> Column:
        return F.transform(run(q), lambda x: F.struct(x.alias("id"), F.lit(1 << r).alias("flag")))

    met = postings.select(F.explode(F.flatten(F.array(*(flagged(r, q) for r, q in queries.items())))).alias("x")).select("x.id", "x.flag")
    return met.groupBy("id").agg(F.bit_or("flag").alias("flags"))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _folded(items: Column, made: str, step) -> Column:
    """(at, out): step(state of (at, out), item) from the left; arrays grow by CHUNK items and are put together once, so long ones take linear time."""
    none = F.array().cast(f"array<{made}>")
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{made}>>").alias("out"))

    def each(state: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), step, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    def parts(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)))

    return _bound(items, lambda all_: F.aggregate(parts(all_), first, each, lambda r: F.struct(r["at"].alias("at"), F.flatten(r["out"]).alias("out"))))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's matches, of which there are some: what stands between matches tells where they are."""
    found, between = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    size = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["p"]
        end = start + x["m"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["g"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def lengths(c: Column) -> Column:
        return F.transform(c, lambda x: F.length(x))

    rows = F.zip_with(F.zip_with(lengths(found), F.slice(lengths(between), F.lit(1), F.size(found)), lambda m, p: F.struct(p.alias("p"), m.alias("m"))), lengths(size), lambda x, g: F.struct(x["p"].alias("p"), x["m"].alias("m"), g.alias("g")))
    return _folded(rows, "struct<start:int,order:int,end:int,kind:string>", step)["out"]


def _long_run(rule: Rule) -> Rule:
    """A rule of one repeated class demands its length in the regex: the same matches, and no short ones to drop."""
    if rule.group == 0 and rule.least > 1 and rule.regex.startswith("[") and rule.regex.endswith("]+"):
        return Rule(rule.kind, f"{rule.regex[:-1]}{{{rule.least},}}", 0, 1, rule.base)
    return rule


def _holds(low: Column, q: Query) -> Column:
    """Whether a lower-cased text satisfies a query."""
    if isinstance(q, str):
        return F.contains(low, F.lit(q))
    return reduce(lambda a, b: a & b if q[0] == "and" else a | b, (_holds(low, x) for x in q[1]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, to: str = "spans", listed: int = LISTED) -> DataFrame:
    """`docs` with a column `to` of all spans: array<struct<start,order,end,kind>>, sorted by start, then rule."""
    key, flags, made = free_names([*docs.columns, to], "id", "flags", "made")
    found = Scratch(docs.sparkSession, "secrets").keep(candidates(docs, rules, id_col, text_col)).toDF(key, flags)
    queries = [q for q in (trigram_query(r.regex) for r in rules) if q is not True]
    if not queries:
        both = docs.withColumn(flags, F.lit(0))
    elif found.count() <= listed:
        both = docs.join(F.broadcast(found), docs[id_col] == found[key], "left").drop(key)
    else:
        may = F.coalesce(F.col(id_col).isNotNull() & reduce(lambda a, b: a | b, (_holds(F.lower(text_col), q) for q in queries)), F.lit(False))
        some = docs.where(may)
        both = some.join(found, some[id_col] == found[key], "left").drop(key).unionByName(docs.where(~may).withColumn(flags, F.lit(None).cast("int")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    cols = []
    for r, rule in enumerate(rules):
        scanned = _long_run(rule)
        on = text.rlike(scanned.regex)
        if trigram_query(rule.regex) is not True:
            on = ((F.coalesce(F.col(flags), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0) | F.col(id_col).isNull()) & on
        cols.append(F.when(on, _spans(text, scanned, r)).otherwise(none))
    out = both.withColumn(made, F.array_sort(F.concat(*cols)))
    return out.select(*(c for c in docs.columns if c != to), F.col(made).alias(to))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with each secret, overlapping ones as one, replaced by MASK; a text without secrets is as it was."""
    (spans,) = free_names(docs.columns, "spans")
    found = secrets(docs, id_col, text_col, rules, spans)
    text = F.col(text_col)

    def step(state: Column, s: Column) -> Column:
        before = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(MASK))
        apart = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(before)).alias("out"))
        return F.when(s["start"] >= state["at"], apart).otherwise(F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out")))

    cut = _bound(_folded(F.col(spans), "string", step), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(text, r["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, cut).otherwise(text)).drop(spans)
