"""Conversation structure repair by error-correcting Earley parsing.

A whole conversation has the roles ``(system? (user assistant)+)?``. The grammar
of that has productions for errors too: a turn may be deleted, its role be
changed, and an empty turn be inserted, each at a cost. Every item of the chart
keeps the least (cost, audit) of all derivations of it, where the audit is the
string of the edits' initials; the item that completes the whole conversation
gives the repair.

Turns are put in order, compared and judged by DataFrame functions. The parser
sees one letter a turn, and conversations of like letters are parsed once by a
worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table

#: What is not visible in a text.
BLANKS = " \t\n\x0b\x0c\r"
#: Terminals: a turn of that role's initial; a turn of any role that may stay; any turn.
ROLES, ANY_TURN, ANY_ROW = "sua", "turn", "row"
#: Letter of a turn that must be deleted; others are their role's initial or ``x``, upper case if cut short.
MUST_GO, OTHER = "d", "x"
#: (left side, right side, cost, edit). Items of the first five are left-recursive, so they all begin at the first turn, and a column of the chart has a fixed number of items.
GRAMMAR: tuple[tuple[str, tuple[str, ...], int, str], ...] = (
    ("Dialogue", ("Nothing",), 0, ""),
    ("Dialogue", ("Full",), 0, ""),
    ("Nothing", (), 0, ""),
    ("Nothing", ("Nothing", "Gone"), 0, ""),
    ("Open", ("Nothing",), 0, ""),
    ("Open", ("Nothing", "System"), 0, ""),
    ("Open", ("Open", "Gone"), 0, ""),
    ("Half", ("Open", "User"), 0, ""),
    ("Half", ("Full", "User"), 0, ""),
    ("Half", ("Half", "Gone"), 0, ""),
    ("Full", ("Half", "Assistant"), 0, ""),
    ("Full", ("Full", "Gone"), 0, ""),
    ("System", ("s",), 0, "K"),
    ("User", ("u",), 0, "K"),
    ("User", (ANY_TURN,), 2, "R"),
    ("User", (), 2, "I"),
    ("Assistant", ("a",), 0, "K"),
    ("Assistant", (ANY_TURN,), 2, "R"),
    ("Assistant", (), 2, "I"),
    ("Gone", (ANY_ROW,), 3, "D"),
)
#: What a turn that is cut short costs if it stays.
CUT_SHORT = 1
_OF: dict[str, list[int]] = {}
for _at, (_left, *_) in enumerate(GRAMMAR):
    _OF.setdefault(_left, []).append(_at)

Item = tuple[int, int, int]  # production, dot, column where it begins
Weight = tuple[int, str]  # cost, audit


def _scanned(terminal: str, letter: str) -> int | None:
    """What it costs besides the production to read a letter as a terminal, None if it is not one."""
    if terminal == ANY_ROW:
        return 0
    if letter == MUST_GO or terminal != ANY_TURN and letter.lower() != terminal:
        return None
    return CUT_SHORT if letter.isupper() else 0


class _Column:
    """Items that end before one turn, each with its least weight."""

    def __init__(self, at: int, chart: dict[int, _Column]):
        self.at, self.chart = at, chart
        self.items: dict[Item, Weight] = {}
        self.waiting: dict[str, set[Item]] = {}
        self.done: dict[str, Weight] = {}  # what is complete and has no turn
        chart[at] = self

    def add(self, item: Item, weight: Weight) -> None:
        """Take in an item and all that follows from it within the column; again if its weight is less than before."""
        agenda = [(item, weight)]
        while agenda:
            item, weight = agenda.pop()
            if item in self.items and self.items[item] <= weight:
                continue
            self.items[item] = weight
            production, dot, begin = item
            left, right, cost, edit = GRAMMAR[production]
            if dot == len(right):
                weight = (weight[0] + cost, weight[1] + edit)
                if begin == self.at:
                    if left in self.done and self.done[left] <= weight:
                        continue
                    self.done[left] = weight
                for other in list(self.chart[begin].waiting.get(left, ())):
                    agenda.append(self._over(other, self.chart[begin].items[other], weight))
            elif (symbol := right[dot]) in _OF:
                self.waiting.setdefault(symbol, set()).add(item)
                agenda.extend(((p, 0, self.at), (0, "")) for p in _OF[symbol])
                if symbol in self.done:
                    agenda.append(self._over(item, weight, self.done[symbol]))

    @staticmethod
    def _over(item: Item, weight: Weight, part: Weight) -> tuple[Item, Weight]:
        return (item[0], item[1] + 1, item[2]), (weight[0] + part[0], weight[1] + part[1])


@lru_cache(maxsize=1 << 16)
def parse(letters: str) -> Weight:
    """The least (cost, audit) that makes a whole conversation of these turns.

    Columns are forgotten when no item that is left begins there, so the chart
    does not grow with the conversation. Of equal costs, no audit of an item is
    the beginning of another one's, so the least audit of the parts gives the
    least of the whole.
    """
    chart: dict[int, _Column] = {}
    column = _Column(0, chart)
    for production in _OF["Dialogue"]:
        column.add((production, 0, 0), (0, ""))
    for at, letter in enumerate(letters):
        after = _Column(at + 1, chart)
        for (production, dot, begin), (cost, audit) in column.items.items():
            right = GRAMMAR[production][1]
            if dot < len(right) and right[dot] not in _OF and (more := _scanned(right[dot], letter)) is not None:
                after.add((production, dot + 1, begin), (cost + more, audit))
        column = after
        used = {0, at, at + 1} | {begin for _, _, begin in column.items}
        for old in [c for c in chart if c not in used]:
            del chart[old]
    # completed items: the production's own weight, of which these have none
    return min(w for (p, dot, begin), w in column.items.items() if begin == 0 and GRAMMAR[p][0] == "Dialogue" and dot == len(GRAMMAR[p][1]))


def edits_of(letters: str, audit: str) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, place of the turn from 1, new role) in order; inserted turns have no place, kept and deleted ones no new role."""
    place, role, first = 0, "user", True
    for edit in audit:
        place += edit != "I"
        yield edit, None if edit == "I" else place, role if edit in "RI" else None
        if edit != "D":
            if not (first and edit == "K" and letters[place - 1] in "sS"):
                role = "assistant" if role == "user" else "user"
            first = False


def _letter() -> Column:
    stays = F.when(F.col("initial").isin(*ROLES), F.col("initial")).otherwise(OTHER)
    return F.when(F.col("is_blank") | F.col("is_duplicate"), MUST_GO).when(F.col("is_truncated"), F.upper(stays)).otherwise(stays)


def judged(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns with ``place`` (from 1), their faults, and ``letter``, the parser's view of them. Only a turn's first fault is set."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    whole = Window.partitionBy(key).orderBy(*order)
    alike = Window.partitionBy(key, "role", "text").orderBy("place")
    seen = F.rtrim("text", F.lit(BLANKS))
    rows = turns.select(key, "turn", "role", "text").withColumns({"initial": F.substring("role", 1, 1), "is_blank": seen == "", "last": F.substring(seen, -1, 1)})
    before = F.lag("initial").over(whole)
    rows = rows.withColumns({"place": F.row_number().over(whole), "is_illegal": before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au"), "is_new_turn": F.col("turn").isNotNull() & ~F.lag("turn").over(whole).eqNullSafe(F.col("turn"))})
    rows = rows.withColumn("is_duplicate", ~F.col("is_blank") & (F.row_number().over(alike) > 1))
    rows = rows.withColumn("is_truncated", ~F.col("is_blank") & ~F.col("is_duplicate") & ~F.col("last").isin(".", "!", "?"))
    return rows.withColumn("letter", _letter())


def repair(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row a conversation: ``key``, counts of what is wrong, ``cost``, ``audit`` and ``edits``, the repaired turns among deleted ones.

    ``turns`` has ``key, turn, role, text``; other columns are left out. Turns
    are in the order of ``turn``, nulls first, those of one number in that of
    role and text. Null roles and texts are one space. A role with another
    initial than s, u or a, or none, cannot stay as it is. Repeated rows are
    duplicates. A null key is a conversation like others. No turns, no row.
    A row holds a whole conversation: it is what one is rendered and hashed
    from. It is sorted by Spark, which spills to disk.
    """
    small_batches(turns.sparkSession)
    clean = turns.withColumns({c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")})
    count = lambda c: F.count_if(F.col(c))
    rows = judged(clean.repartition(key), key).groupBy(key).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count("is_new_turn"), F.lit(0)).cast("long").alias("gaps"),
        count("is_blank").alias("blank"),
        count("is_duplicate").alias("duplicate"),
        count("is_truncated").alias("truncated"),
        count("is_illegal").alias("illegal"),
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "letter"))).alias("turns"),
    )

    @F.pandas_udf("cost long, audit string, edits array<struct<edit: string, place: int, role: string>>")
    def parsed(letters: pd.Series) -> pd.DataFrame:
        found = [(*parse(x), x) for x in letters]
        return pd.DataFrame({"cost": [c for c, _, _ in found], "audit": [a for _, a, _ in found], "edits": [[{"edit": e, "place": p, "role": r} for e, p, r in edits_of(x, a)] for _, a, x in found]})

    own = rows.withColumn("parsed", parsed(F.array_join(F.transform("turns", lambda t: t["letter"]), "")))
    old = lambda e: F.get(F.col("turns"), e["place"] - 1)
    edits = F.transform("parsed.edits", lambda e: F.struct(e["edit"].alias("edit"), F.coalesce(e["role"], old(e)["role"]).alias("role"), F.coalesce(old(e)["text"], F.lit("")).alias("text")))
    return own.select(key, "gaps", "blank", "duplicate", "truncated", "illegal", "parsed.cost", "parsed.audit", edits.alias("edits"))


def repaired_text(edits: Column) -> Column:
    """``role:text`` of the turns that a repair leaves, a line break between."""
    return F.array_join(F.transform(F.filter(edits, lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by a hash of conversation and turn: of 20 turns one each is dropped, emptied, without ends of sentences, repeated, and said by the user. Nulls are one space, but for turn numbers."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.expr("crc32(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))) % 20").alias("fate"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("fate != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).drop("one")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all ``conversations``, damaged; those of which nothing is left have no edits."""
    turns = table(spark, sf_dir, "conversations")
    done = repair(damaged(turns)).withColumn("repaired_sha256", F.sha2(repaired_text(F.col("edits")), 256)).drop("edits")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    rows = ids.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return rows.select(F.col("id").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
