"""Views of the triple table, pattern matching, and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import TRIPLE_COLUMNS
from ..plans.scratch import join_checked, saved

Pattern = tuple[str, str, str]


def of(t: DataFrame, p: str) -> DataFrame:
    """(s, o) of one predicate; with a table partitioned by p only its files are read."""
    return t.where(F.col("p") == p).select("s", "o")


def types(t: DataFrame) -> DataFrame:
    return of(t, "type").select("s", F.col("o").alias("class")).distinct()


def labels(t: DataFrame) -> DataFrame:
    """(s, label, is_cn) from name and cnLabel."""
    return t.where(F.col("p").isin("name", "cnLabel") & (F.col("o_kind") == "literal")).select("s", F.col("o").alias("label"), (F.col("p") == "cnLabel").alias("is_cn"))


def tail(c: str = "s") -> Column:
    return F.element_at(F.split(c, "/"), -1)


def names(t: DataFrame) -> DataFrame:
    """(s, name) of the subjects that have one: the least name, else the least cnLabel. Reads these two predicates only."""
    known = t.where(F.col("p").isin("name", "cnLabel"))
    return known.groupBy("s").agg(
        F.min(F.when(F.col("p") == "name", F.col("o"))).alias("n"), F.min(F.when(F.col("p") == "cnLabel", F.col("o"))).alias("c")
    ).select("s", F.coalesce("n", "c").alias("name"))


def called(rows: DataFrame, t: DataFrame, column: str = "s", name: str = "name") -> DataFrame:
    """rows with the name of the column's ids: names()'s, else the end of the id.

    Names are written before they are joined, so that an id which very many rows share can be split.
    """
    known = saved(names(t)).select(F.col("s").alias(column), F.col("name").alias(name))
    return rows.hint("merge").join(known, column, "left").withColumn(name, F.coalesce(name, tail(column)))


def least_class(t: DataFrame) -> DataFrame:
    """(s, class): the least class of each typed subject. Write it before a join with rows that share subjects."""
    return of(t, "type").groupBy("s").agg(F.min("o").alias("class"))


def canonical_of(nodes: DataFrame, canonical: DataFrame, column: str) -> DataFrame:
    """nodes with the column replaced by its canonical id. canonical: (uri, canonical_uri), only of merged entities."""
    known = canonical.select(F.col("uri").alias(column), "canonical_uri")
    return nodes.join(known, column, "left").withColumn(column, F.coalesce("canonical_uri", column)).drop("canonical_uri")


def representative(nodes: DataFrame, canonical: DataFrame) -> DataFrame:
    """(uri, canonical_uri) of every node."""
    return nodes.select("uri").join(canonical, "uri", "left").select("uri", F.coalesce("canonical_uri", "uri").alias("canonical_uri"))


def aliases(nodes: DataFrame, canonical: DataFrame) -> DataFrame:
    """(uri, alias): all members of each node's class, itself included."""
    mine = representative(nodes, canonical)
    members = canonical.select(F.col("uri").alias("alias"), "canonical_uri")
    return mine.join(members, "canonical_uri").select("uri", "alias").unionByName(mine.select("uri", F.col("uri").alias("alias"))).distinct()


def predicate_objects(t: DataFrame, canonical: DataFrame) -> DataFrame:
    """Triples with canonical subjects: what all aliases say, distinct."""
    return canonical_of(t, canonical, "s").select(TRIPLE_COLUMNS).distinct()


# ---- patterns


def _variable(term: str) -> str | None:
    return term[1:] if term.startswith("?") else None


def scan(t: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of one pattern with a variable at least; terms that begin with ? are variables, others are fixed."""
    rows, out = t, {}
    for column, term in zip(("s", "p", "o"), pattern, strict=True):
        v = _variable(term)
        if v is None:
            rows = rows.where(F.col(column) == term)
        elif v in out:
            rows = rows.where(F.col(column) == F.col(out[v]))
        else:
            out[v] = column
    return rows.select([F.col(c).alias(v) for v, c in out.items()]).distinct()


def _variables(pattern: Pattern) -> set[str]:
    return {v for v in map(_variable, pattern) if v is not None}


@dataclass(frozen=True)
class Sizes:
    """What estimates rest on: rows (p, triples, subjects, objects), and (p, o, n) of the objects of predicates that have few.

    They are looked up for the predicates of a question only, so the driver holds a few rows for each pattern.
    """

    predicates: DataFrame
    objects: DataFrame


#: A predicate with at most so many objects has them counted one by one.
FEW_OBJECTS = 1000
#: A pattern of fewer estimated rows reduces larger ones before they are shuffled.
REDUCING = 200_000


def statistics(t: DataFrame, exact: bool = False) -> Sizes:
    """Triples, subjects and objects of each predicate, estimated to some percent unless exact. Written, so that later questions share them."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    predicates = saved(t.groupBy("p").agg(F.count("*").alias("triples"), distinct("s").alias("subjects"), distinct("o").alias("objects")))
    few = predicates.where(F.col("objects") <= FEW_OBJECTS).select("p")
    return Sizes(predicates, saved(t.join(F.broadcast(few), "p", "left_semi").groupBy("p", "o").agg(F.count("*").alias("n"))))  # few: one row a predicate


class _Estimates:
    """Rows of patterns and of their joins, in doubles."""

    def __init__(self, sizes: Sizes, patterns: Sequence[Pattern]):
        fixed = sorted({p for _, p, _ in patterns if not _variable(p)})
        own = sizes.predicates.where(F.col("p").isin(fixed)).unionByName(
            sizes.predicates.agg(F.lit(None).cast("string").alias("p"), *[F.sum(c).alias(c) for c in ("triples", "subjects", "objects")]))
        self.of = {r["p"]: tuple(float(r[c] or 0) for c in ("triples", "subjects", "objects")) for r in own.collect()}
        pairs = [(F.col("p") == p) & (F.col("o") == o) for _, p, o in patterns if not _variable(p) and not _variable(o)]
        known = sizes.objects.where(reduce(Column.__or__, pairs)).collect() if pairs else []
        self.objects = {(r["p"], r["o"]): float(r["n"]) for r in known}

    def rows(self, pattern: Pattern) -> float:
        s, p, o = pattern
        triples, subjects, objects = self.of.get(None if _variable(p) else p, (0.0, 0.0, 0.0))
        n = triples if _variable(s) else triples / max(subjects, 1.0)
        return n if _variable(o) else min(n, self.objects.get((p, o), n / max(objects, 1.0)))

    def values(self, pattern: Pattern, variable: str) -> float:
        """Different values of a variable in a pattern's rows."""
        _, subjects, objects = self.of.get(None if _variable(pattern[1]) else pattern[1], (0.0, 0.0, 0.0))
        most = subjects if _variable(pattern[0]) == variable else objects
        return max(1.0, min(most, self.rows(pattern)))


def _in_order(patterns: Sequence[Pattern], estimates: _Estimates | None = None) -> list[Pattern]:
    """The patterns so that each shares a variable with those before it, those that keep the bindings fewest first.

    Without estimates those with more fixed terms come first.
    """
    left, out = list(patterns), []
    values: dict[str, float] = {}
    rows = 1.0
    while left:
        linked = [p for p in left if not values or _variables(p) & values.keys()]
        if not linked:
            raise ValueError(f"patterns share no variable with the others: {left}")

        def cost(p: Pattern) -> tuple[float, int]:
            if estimates is None:
                return 0.0, len(_variables(p))
            return rows * estimates.rows(p) / max([max(values[v], estimates.values(p, v)) for v in _variables(p) & values.keys()], default=1.0), len(_variables(p))

        best = min(linked, key=cost)
        left.remove(best)
        out.append(best)
        rows = max(cost(best)[0], 1.0)
        for v in _variables(best):
            here = estimates.values(best, v) if estimates else 1.0
            values[v] = min(values.get(v, here), here)
    return out


def _reduced(t: DataFrame, pattern: Pattern, others: dict[Pattern, DataFrame]) -> DataFrame:
    """A pattern's bindings that every one of the small patterns (with their written bindings) has a partner for."""
    out = scan(t, pattern)
    for small, bindings in others.items():
        shared = sorted(_variables(small) & _variables(pattern))
        if small != pattern and shared:
            out = join_checked(out, bindings.select(*shared).distinct(), shared, "left_semi")
    return out


def _present(t: DataFrame, fixed: Sequence[Pattern]) -> bool:
    """Whether all patterns without a variable are triples."""
    one = lambda s, p, o: (F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)
    return not fixed or t.where(reduce(Column.__or__, [one(*p) for p in fixed])).select("s", "p", "o").distinct().limit(len(set(fixed))).count() == len(set(fixed))


def match(t: DataFrame, patterns: Sequence[Pattern], optional: Sequence[Sequence[Pattern]] = (), where: Column | str | None = None, order: Sequence[str | Column] = (), limit: int | None = None, sizes: Sizes | None = None) -> DataFrame:
    """Bindings of all patterns, one column for each variable, distinct.

    Patterns join on the variables they share, in an order in which each shares one with those
    before it; patterns that can't be connected are an error. Those without a variable are looked up
    first, and without one of them there is no binding. optional: groups of patterns
    that may be missing, whose variables are then null. order, limit: of the bindings.
    sizes: statistics of t; with them the order follows estimates, and patterns of few rows
    first thin out the larger ones that share a variable with them.
    """
    if not patterns:
        raise ValueError("no pattern")
    wanted = list(dict.fromkeys(v for p in [*patterns, *[p for g in optional for p in g]] for v in map(_variable, p) if v is not None))
    fixed, free = [p for p in patterns if not _variables(p)], [p for p in patterns if _variables(p)]
    there = _present(t, fixed)
    if not free:
        if optional:
            raise ValueError(f"optional patterns share no variable with the others: {list(optional[0])}")
        return t.sparkSession.range(1 if there else 0).select(F.lit(True).alias("matched"))
    estimates = _Estimates(sizes, free) if sizes is not None else None
    small = {p: saved(scan(t, p)) for p in free if estimates.rows(p) <= REDUCING and any(estimates.rows(q) > 4 * estimates.rows(p) for q in free)} if estimates else {}
    out = None
    for p in _in_order(free, estimates):
        one = small[p] if p in small else _reduced(t, p, small)
        if out is None:
            out = one
        else:
            shared = [c for c in out.columns if c in one.columns]
            out = join_checked(out, one, shared) if p in small else out.join(one, shared)
    out = out if there else out.where("false")
    for group in optional:
        some = match(t, group)
        shared = [c for c in out.columns if c in some.columns]
        if not shared:
            raise ValueError(f"optional patterns share no variable with the others: {group}")
        out = out.join(some, shared, "left")
    out = out.where(where) if where is not None else out
    out = out.select(wanted).distinct()
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def ask(t: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """One row: whether the patterns match."""
    return match(t, patterns).limit(1).agg((F.count("*") > 0).alias("answer"))


def construct(bindings: DataFrame, template: Sequence[Pattern], kind: str = "uri") -> DataFrame:
    """Triples from bindings, one for each template whose variables are bound."""
    term = lambda x: F.col(_variable(x)) if _variable(x) else F.lit(x)
    made = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")) for s, p, o in template])
    return bindings.select(F.explode(made).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()


def describe(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """All triples of the nodes (column uri)."""
    return t.join(nodes.select(F.col("uri").alias("s")), "s", "left_semi").select(TRIPLE_COLUMNS)


def tabulate(bindings: DataFrame) -> DataFrame:
    """Bindings as text, unbound ones empty."""
    return bindings.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in bindings.columns])


# ---- statistics


def stats(t: DataFrame) -> DataFrame:
    """One row: triples and distinct typed entities."""
    return t.agg(F.count("*").alias("triples"), F.countDistinct(F.when(F.col("p") == "type", F.col("s"))).alias("entities"))


def class_histogram(t: DataFrame) -> DataFrame:
    return types(t).groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


def list_ontology(t: DataFrame, canonical: DataFrame) -> DataFrame:
    """Entities of each class, canonical and raw."""
    mine = types(t).withColumn("raw", F.col("s"))
    return canonical_of(mine, canonical, "s").groupBy("class").agg(F.countDistinct("s").alias("n"), F.countDistinct("raw").alias("raw_n")).orderBy("class")
