"""Look-ups that go on with the one name that what they found calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .lookup import is_many, matching_names, prepared_terms, unsent
from .ranges import union_ranges

HELD = 16  # callees of a caller that are looked at without the table of all calls
STATE = ["how", "asked", "full_pattern", "seen"]


def call_edges(calls: DataFrame, first: Column | None = None) -> DataFrame:
    """``caller, callee`` of ``calls_by_definition``; with ``first``, a condition on a call's file, also whether any call meets it."""
    rows = calls.withColumn("first", first if first is not None else F.lit(True))
    return rows.select(F.explode("names").alias("caller"), "callee", "first").groupBy("caller", "callee").agg(F.max("first").alias("first"))


def callers(edges: DataFrame) -> DataFrame:
    """``caller, callees``: the first callees in order, ``HELD`` of them, and one more where there are more."""
    order = Window.partitionBy("caller").orderBy("callee")
    few = edges.select("caller", "callee").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= HELD + 1)
    return few.groupBy("caller").agg(F.collect_list("callee").alias("callees"))


def _left(callees: str) -> Column:
    """Callees that neither the term's own pattern matches nor a name followed since is."""
    tested = "x -> NOT (IF(how = 'equal', x = asked, x RLIKE full_pattern) OR array_contains(seen, x))"
    return F.expr(f"filter({callees}, {tested})")


def only_callee(front: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The terms whose names at hand call exactly one name that no earlier pattern of theirs matches, with that name.

    ``front`` has ``term_id, name`` and the state. One is all there is if the least and the greatest are equal, which folds before
    the shuffle. A caller of very many is decided by its first callees, two of which nearly always are left; only where they
    are not, the table of calls is asked.
    """
    many = is_many(front)
    met = front.join(unsent(nodes, many), front["name"] == nodes["caller"]).withColumn("left", _left("callees"))
    decided = (F.size("callees") <= HELD) | (F.size("left") > 1)
    found = met.where(decided).select("term_id", *STATE, F.explode(F.slice("left", 1, 2)).alias("callee"))
    open_ = cut(met.where(~decided).select("term_id", *STATE, "caller"))
    if not open_.isEmpty():
        full = unsent(open_, many).join(edges.select("caller", "callee"), "caller").select("term_id", *STATE, "callee")
        found = found.unionByName(full.withColumn("left", _left("array(callee)")).where(F.size("left") > 0).drop("left"))
    one = found.groupBy("term_id").agg(F.min("callee").alias("name"), F.max("callee").alias("_last"), F.first(F.struct(*STATE)).alias("_state"))
    return one.where("name = _last").select("term_id", "_state.*", "name")


def followed(front: DataFrame, edges: DataFrame, first_edges: DataFrame | None = None) -> DataFrame:
    """``term_id, round, name``: the name that each term goes on with in each round from the second on.

    Rounds end when no term has one left. A round joins what is at hand with one row per caller, and only what is at hand is written
    and moved: callers stay where they were put together.
    """
    nodes = cut(callers(edges), placed=True)
    rounds = []
    now = front
    while True:
        here, calls = (cut(callers(first_edges)), first_edges) if first_edges is not None and not rounds else (nodes, edges)
        nexts = only_callee(now, here, calls).withColumn("seen", F.array_append("seen", F.col("name")))
        now = cut(nexts.select("term_id", *STATE, "name"))
        if now.isEmpty():
            break
        rounds.append(now.select("term_id", F.lit(len(rounds) + 2).alias("round"), "name"))
    if not rounds:
        return now.select("term_id", F.lit(0).alias("round"), "name")
    out = rounds[0]
    for one in rounds[1:]:
        out = out.unionByName(one)
    return out


def recursive_lookup(index: DataFrame, edges: DataFrame, terms: DataFrame, gap: int = 0) -> DataFrame:
    """Merged ranges per term, round and file: ``term_id, round, file_id, start_line, end_line``.

    Round one is the look-up of the term. As long as all that a round found calls exactly one name that no earlier pattern of the
    term matches, the next round looks up that name: literally, and in its own case. The term's own pattern counts as an earlier
    one in the case it was asked in, so names that it would find again do not count.

    ``index`` has ``name, file_id, ranges``, ``edges`` are ``call_edges``; both are best read from storage. Where
    ``index`` has a column ``first``, round one looks only where it holds, and goes on from calls there: in-memory
    input is searched alone first, later rounds search all. ``term_id`` is unique.
    """
    scoped = "first" in index.columns
    here = index.where("first") if scoped else index
    ready = cut(prepared_terms(terms))
    matched = cut(matching_names(here.select("name").distinct(), ready))
    state = ready.where("status = 'ok'").select("term_id", "how", "asked", "full_pattern", F.array().cast("array<string>").alias("seen"))
    many = is_many(ready)
    later = followed(cut(matched.join(unsent(state, many), "term_id")), edges, edges.where("first") if scoped else None)

    def shown(rows: DataFrame, found: DataFrame) -> DataFrame:
        both = rows.select("name", "file_id", "ranges").join(unsent(found, many), "name")
        return both.select("term_id", "round", "file_id", F.explode("ranges").alias("r")).select("term_id", "round", "file_id", "r.start_line", "r.end_line")

    first = matched.withColumn("round", F.lit(1))
    flat = shown(here, first).unionByName(shown(index, later)) if scoped else shown(index, first.unionByName(later))
    return union_ranges(flat, ["term_id", "round", "file_id"], gap)


def single_callee_chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Follow each start name while its definitions call exactly one name not yet visited.

    ``edges`` has ``caller, callee``; ``starts`` has ``term_id, name``. Returns ``term_id, step, name``. A term may have
    several starts, which are followed each on its own.
    """
    none = F.array().cast("array<string>")
    own = F.struct("term_id", "name")
    front = cut(starts.select("term_id", "name").distinct()).select(
        own.alias("term_id"), F.lit("equal").alias("how"), F.col("name").alias("asked"), F.lit("").alias("full_pattern"), none.alias("seen"), "name"
    )
    later = followed(front, edges).select("term_id.term_id", (F.col("round") - 1).alias("step"), "name")
    return front.select("term_id.term_id", F.lit(0).alias("step"), "name").unionByName(later)
