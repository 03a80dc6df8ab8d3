"""Repair of conversations' structure by weighted interval parsing (operator 13).

What a repaired conversation may be is a regular language over roles: nothing, or an optional system turn and then pairs of
user and assistant. Its grammar in Chomsky normal form has a nonterminal [p, q] for every way from a state p to a state q, the
rules [p, q] -> [p, r] [r, q], and a row's edits (keep, rerole, delete) as terminals. Inserted turns derive from nothing; they
are closed over before and after every row. Cells of the chart hold the cheapest cost of a nonterminal over a span of rows and
the least audit of that cost, and are combined bottom-up by the span's length over all its splits.

A row of Spark is a conversation. Faults are found and repaired texts are put together by DataFrame functions; Python sees one
character a row, what it may become.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .sql import CRC_TABLE, crc32_sql

RENAME, DELETE, TRUNCATED, INSERT = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: The language as an automaton: (state, role initial) to state. 0 nothing yet, 1 after system, 2 after user, 3 after a pair.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
START, ENDS = 0, (0, 3)
#: What a turn that is not there can be in each state, which is what a reroled one becomes, too.
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
#: Rows in a chart. Longer conversations are charts of charts: by the rules' form any split of a span gives its cheapest cell.
CHART = 12

#: (cost, audits): the least audit, and those that it begins, of which a longer one can be less once something follows.
Cell = dict[tuple[int, int], tuple[int, tuple[str, ...]]]


def _least(audits: set[str]) -> tuple[str, ...]:
    """The least audit and what may still turn out less: among others only those that begin with it, and so on."""
    out: list[str] = []
    for audit in sorted(audits):
        if not out or audit.startswith(out[-1]):
            out.append(audit)
    return tuple(out)


def _best(found: list[tuple[int, tuple[str, ...], tuple[str, ...]]]) -> tuple[int, tuple[str, ...]]:
    cost = min(c for c, _, _ in found)
    return cost, _least({a + b for c, x, y in found if c == cost for a in x for b in y})


def _joined(splits: list[tuple[Cell, Cell]]) -> Cell:
    """The cell of a span by all its splits and rules."""
    found: dict[tuple[int, int], list] = {}
    for left, right in splits:
        for (p, r), (cost, audits) in left.items():
            for q in range(4):
                other = right.get((r, q))
                if other:
                    found.setdefault((p, q), []).append((cost + other[0], audits, other[1]))
    return {k: _best(v) for k, v in found.items()}


def _insertions() -> Cell:
    """Nonterminals over no rows: nothing, or the fewest inserted turns that lead from one state to another."""
    out: Cell = {}
    for p in range(4):
        q, n = p, 0
        while (p, q) not in out:
            out[p, q] = (INSERT * n, ("I" * n,))
            q, n = STEPS[q, WANTED[q]], n + 1
    return out


INSERTED = _insertions()


@functools.cache
def _row(kind: str) -> Cell:
    """The cell of one row, inserted turns around it included. ``kind``: x (must go), else its role's initial or o, upper case if truncated."""
    found: dict[tuple[int, int], list] = {(p, p): [(DELETE, ("D",), ("",))] for p in range(4)}
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        for p in range(4):
            if (p, kind.lower()) in STEPS:
                found.setdefault((p, STEPS[p, kind.lower()]), []).append((more, ("K",), ("",)))
            found.setdefault((p, STEPS[p, WANTED[p]]), []).append((RENAME + more, ("R",), ("",)))
    own = {k: _best(v) for k, v in found.items()}
    return _joined([(_joined([(INSERTED, own)]), INSERTED)])


def _chart(cells: list[Cell]) -> Cell:
    n = len(cells)
    spans = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            spans[i, i + size] = _joined([(spans[i, k], spans[k, i + size]) for k in range(i + 1, i + size)])
    return spans[0, n]


@functools.lru_cache(maxsize=1 << 14)
def parse(kinds: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows of these kinds; of equally cheap ones the least audit."""
    cells = [_row(k) for k in kinds] or [INSERTED]
    while len(cells) > 1:
        cells = [_chart(cells[k : k + CHART]) for k in range(0, len(cells), CHART)]
    cost, audits = min((cells[0][START, q] for q in ENDS if (START, q) in cells[0]), key=lambda x: (x[0], x[1][0]))
    return cost, audits[0]


def repaired_turns(kinds: str, audit: str) -> list[tuple[int, str | None]]:
    """The repaired turns: the row's place (-1: inserted), and the role where it is not the row's own."""
    out: list[tuple[int, str | None]] = []
    state, at = START, 0
    for edit in audit:
        if edit in "RI":
            out.append((at if edit == "R" else -1, ROLES[WANTED[state]]))
            state = STEPS[state, WANTED[state]]
        elif edit == "K":
            out.append((at, None))
            state = STEPS[state, kinds[at].lower()]
        at += edit != "I"
    return out


# -- conversations ------------------------------------------------------------------------------------------------------

_WHITE = r"\x20\x09-\x0D"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``there`` (false for a dropped row), damaged by a checksum of conversation and turn.

    0 drops a row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it the user's. A null is one
    space, in the checksum's text as well.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    rows = rows.withColumn("__code", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20)
    text = F.when(F.col("__code") == 1, "").when(F.col("__code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("__code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.select("conv_id", "turn", F.when(F.col("__code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("__code") != 0).alias("there"), times.alias("__time"))
    return rows.drop("__time")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    ``rows`` has conv_id, turn, role, text and, where it has it, ``there``: rows that are not there only make their conversation
    known. Turns go by number, null first; equal numbers go by role, then text. A null role or text is one space; a null
    conv_id is a conversation. ``repaired`` has role:text of each repaired turn, a line each, and is empty where nothing is
    left; without rows all counts are 0 and the audit is empty. Other columns are ignored; an empty table gives no rows.

    All of a conversation is in one row, as its repaired text is; a text that repeats is found by a window over equal texts.
    """
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.coalesce(there, F.lit(True)).alias("there"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "there").orderBy(F.asc_nulls_first("turn"))) > 1
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    fault = F.when(blank, "b").when(again, "d").when(~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"), "t").otherwise("")
    rows = rows.select("conv_id", "turn", "there", F.struct("turn", "role", "text", fault.alias("fault")).alias("row"))
    turn = F.when(F.col("there"), F.col("turn"))
    groups = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("there"), F.col("row")))).alias("rows"), F.min(turn).alias("low"), F.max(turn).alias("high"), F.count_distinct(turn).alias("distinct")
    )
    initial = lambda r: F.substring(r["role"], 1, 1)
    known = lambda r: F.when(initial(r).isin("s", "u", "a"), initial(r)).otherwise("o")
    kind = lambda r: F.when(r["fault"].isin("b", "d"), "x").when(r["fault"] == "t", F.upper(known(r))).otherwise(known(r))
    count = lambda fault: F.size(F.filter("rows", lambda r: r["fault"] == fault)).cast("long")
    pairs = F.zip_with(F.slice("rows", F.lit(1), F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda x, y: F.concat(initial(x), initial(y)))

    @F.pandas_udf("cost long, audit string, turns array<struct<place:int,role:string>>")
    def parsed(kinds: pd.Series) -> pd.DataFrame:
        found = [(k, *parse(k)) for k in kinds.tolist()]
        return pd.DataFrame({"cost": [c for _, c, _ in found], "audit": [a for _, _, a in found], "turns": [[{"place": p, "role": r} for p, r in repaired_turns(k, a)] for k, _, a in found]})

    groups = groups.withColumn("parsed", parsed(F.array_join(F.transform("rows", kind), "")))
    own = lambda t: F.get("rows", t["place"])
    line = lambda t: F.concat(F.coalesce(t["role"], own(t)["role"]), F.lit(":"), F.when(t["place"] < 0, "").otherwise(own(t)["text"]))
    return groups.select(
        "conv_id",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long").alias("gaps"),
        count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        "parsed.cost", "parsed.audit",
        F.array_join(F.transform("parsed.turns", line), "\n").alias("repaired"),
    )


def repair_digests(rows: DataFrame) -> DataFrame:
    """``repair`` with a digest in place of the repaired text."""
    found = repair(rows)
    return found.select(*[c for c in found.columns if c != "repaired"], F.sha2(F.col("repaired"), 256).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(table(spark, sf_dir, "conversations")))


# -- the same in SQL: rows from the last to the first, for each state the cheapest way on ------------------------------------


def _plus(way: str, cost: int, edit: str) -> str:
    """A way is nine digits of cost and the audit, so the least text is the best way."""
    return f"lpad(cast(cast(left({way}, 9) AS int) + {cost} AS varchar), 9, '0') || '{edit}' || substr({way}, 10)"


def _sql() -> str:
    after = lambda p: STEPS[p, WANTED[p]]
    way = lambda q: f"acc[{q + 1}]"
    inserted = ", ".join(f"least({way(p)}, {_plus(way(after(p)), INSERT, 'I')}, {_plus(way(after(after(p))), 2 * INSERT, 'II')})" for p in range(4))

    def edits(p: int) -> str:
        kept = " ".join(f"WHEN k[1] = '{c}' THEN {_plus(way(q), 0, 'K')} WHEN k[1] = '{c.upper()}' THEN {_plus(way(q), TRUNCATED, 'K')}" for (s, c), q in STEPS.items() if s == p)
        to = way(after(p))
        return f"least({_plus(way(p), DELETE, 'D')}, CASE {kept} END, CASE WHEN k[1] = 'x' THEN NULL WHEN k[1] = lower(k[1]) THEN {_plus(to, RENAME, 'R')} ELSE {_plus(to, RENAME + TRUNCATED, 'R')} END)"

    step = f"CASE WHEN k[1] = '+' THEN [{inserted}] ELSE [{', '.join(edits(p) for p in range(4))}] END"
    last = [("000000000" if p in ENDS else "999999999") for p in range(4)]
    state = f"CASE {' '.join(f'''WHEN acc[2] = '{p}' THEN '{after(p)}' ''' for p in range(4))} END"
    wanted = f"CASE WHEN acc[2] = '2' THEN '{ROLES['a']}' ELSE '{ROLES['u']}' END"
    moved = f"CASE {' '.join(f'''WHEN acc[2] = '{p}' AND left(rows[cast(acc[1] AS int)].role, 1) = '{c}' THEN '{q}' ''' for (p, c), q in STEPS.items())} END"
    here, on = "rows[cast(acc[1] AS int)]", "cast(cast(acc[1] AS int) + 1 AS varchar)"
    told = f"""CASE e[1] WHEN 'D' THEN [{on}, acc[2], acc[3]] WHEN 'I' THEN [acc[1], {state}, acc[3] || chr(10) || {wanted} || ':']
WHEN 'R' THEN [{on}, {state}, acc[3] || chr(10) || {wanted} || ':' || {here}.text] ELSE [{on}, {moved}, acc[3] || chr(10) || {here}.role || ':' || {here}.text] END"""
    return f"""WITH crc AS MATERIALIZED ({CRC_TABLE}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' '))")} % 20 AS code FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS time FROM c WHERE code <> 0),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_WHITE}]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][{_WHITE}]*\\z') THEN 't' ELSE '' END AS fault FROM d),
k AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS known FROM r),
s AS (SELECT conv_id, list(struct_pack(role := role, text := text, kind := CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN fault = 't' THEN upper(known) ELSE known END) ORDER BY turn NULLS FIRST, role, text, fault) AS rows,
max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM k GROUP BY conv_id),
w AS (SELECT *, list_reduce(list_concat([['+']], flatten(list_transform(list_reverse(rows), lambda x: [[x.kind], ['+']]))), lambda acc, k: {step}, {last})[1] AS way FROM s),
a AS (SELECT *, cast(left(way, 9) AS bigint) AS cost, substr(way, 10) AS audit FROM w),
t AS (SELECT *, substr(list_reduce(list_transform(string_split(audit, ''), lambda x: [x]), lambda acc, e: {told}, ['1', '0', ''])[3], 2) AS repaired FROM a)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
coalesce(len(list_filter(range(1, len(rows)), lambda i: left(rows[i].role, 1) || left(rows[i + 1].role, 1) NOT IN ('su', 'ua', 'au'))), 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM v.conv_id"""


OP13_SQL = _sql()
