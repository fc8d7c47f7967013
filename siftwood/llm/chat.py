"""Collapse of cumulative conversation snapshots, with DataFrame functions only.

Chat systems often log a conversation anew after every turn, so a log holds each conversation many times, as ever
longer prefixes.  Each turn's hash is tied to its place, and the hash of a prefix is the exclusive-or of its turns'
hashes: it rolls on from turn to turn, and sums over blocks of turns put together to the same value.  Two such hashes
of 64 bits stand for a prefix.  A conversation is dropped if its whole hash is the hash of a proper prefix of another
(an anti-join on length and hashes); of equal conversations the one with the smallest id stays.  What is left is
rendered turn by turn.

No conversation is gathered: turns are numbered and hashes rolled within blocks of block_turns turns, and blocks are
put together from their totals, so a conversation that holds a third of all rows is spread over many tasks.  Where very
many rows share a turn number, or have none, their block is split by the turn and by the hash that orders them; equal
rows in it are numbered as one run, made of several salted counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.llm._shared import Scratch, sized_broadcast, tasks_for


def prefix_hashes(turns: DataFrame, block_turns: int, scratch: Scratch, most_rows: int = 65_536, salts: int = 64) -> DataFrame:
    """(conv_id, place, h1, h2) for every prefix: the first place turns of the conversation.  Places begin at 1.

    turns: conv_id, turn, t1, t2 (hashes of role and text).  Ties of turn go by the hashes; null turns come last.
    most_rows: a block with more rows is split; salts: into so many counts go its equal rows.
    """
    turn = F.coalesce("turn", F.lit(1 << 62))
    block = F.when(F.col("turn").isNull(), turn).otherwise(F.floor(F.col("turn") / block_turns))
    turns = turns.withColumns({"turn": turn, "block": block})
    crowded = scratch.save(turns.groupBy("conv_id", "block").count().where(F.col("count") > max(most_rows, block_turns)).select("conv_id", "block"))
    n = crowded.count()
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "t1", "t2")
    none = F.lit(0).cast("long")
    if n:
        turns = scratch.save(turns)
        crowded = sized_broadcast(crowded, n, 32)
        even = turns.join(crowded, ["conv_id", "block"], "left_anti")
        runs = turns.join(crowded, ["conv_id", "block"], "left_semi").groupBy(
            "conv_id", "block", "turn", "t1", "t2", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("salt")
        )
        part = F.array("block", "turn", F.shiftright("t1", 52))
        runs = scratch.save(runs.agg(F.count("*").alias("n")).withColumn("block", part))
        before_run = inside.orderBy("turn", "t1", "t2", "salt").rowsBetween(Window.unboundedPreceding, -1)
        starts = runs.withColumn("start", F.coalesce(F.sum("n").over(before_run), none))
        # a run goes in pieces, dealt to many tasks, before it becomes rows again
        at = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1, F.lit(4096).cast("long")))
        pieces = scratch.save(starts.select("conv_id", "turn", "t1", "t2", "block", at.alias("first"), (F.col("start") + F.col("n")).alias("end")))
        pieces = pieces.repartition(tasks_for(turns.sparkSession, pieces.count(), 256), "conv_id", "block", "first")
        place = F.explode(F.sequence("first", F.least(F.col("first") + 4096, F.col("end")) - 1))
        split = pieces.select("conv_id", "turn", "t1", "t2", "block", place.alias("nth")).select(
            "conv_id", "turn", "t1", "t2",
            F.concat("block", F.array(F.floor(F.col("nth") / most_rows))).alias("block"), (F.col("nth") % most_rows + 1).alias("rank"),
        )
    else:
        even = turns
    even = even.withColumn("rank", F.row_number().over(inside).cast("long")).withColumn("block", F.array("block", none, none, none))
    numbered = scratch.save(even.unionByName(split) if n else even)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    offsets = scratch.save(sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    place = (F.col("offset") + F.col("rank")).alias("place")
    tied = numbered.join(offsets, ["conv_id", "block"]).select("conv_id", "block", place, "t1", "t2")
    tied = tied.select("conv_id", "block", "place", F.xxhash64("place", "t1").alias("x1"), F.xxhash64("place", "t2", F.lit("b")).alias("x2"))
    tied = scratch.save(tied)
    totals = tied.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    carried = scratch.save(
        totals.select(
            "conv_id", "block",
            F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("c1"),
            F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("c2"),
        )
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = tied.select(
        "conv_id", "block", "place", F.bit_xor("x1").over(upto).alias("r1"), F.bit_xor("x2").over(upto).alias("r2")
    )
    return rolled.join(carried, ["conv_id", "block"]).select(
        "conv_id", "place", F.col("r1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("c2")).alias("h2")
    )


def maximal_conversations(
    turns: DataFrame, block_turns: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = 65_536
) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no proper prefix of another, one of each set of equal ones.

    n_copies counts the equal conversations, itself included.  A null role or text is a value of its own and equals
    only another null.  Rows with a null conversation id belong to none and are left out here.  Repeated rows are turns
    of their own.  Rows with a null turn come last.  An empty table gives an empty result.
    """
    scratch = Scratch(turns.sparkSession)
    role, text = F.col(role_col), F.col(text_col)
    shape = F.concat(role.isNull().cast("string"), text.isNull().cast("string"))
    hashed = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(shape, role, text).alias("t1"), F.xxhash64(text, role, shape, F.lit("b")).alias("t2"),
    )
    prefixes = scratch.save(prefix_hashes(hashed, block_turns, scratch, most_rows))
    lengths = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    ends = scratch.save(lengths.join(prefixes, (lengths["conv_id"] == prefixes["conv_id"]) & (F.col("place") == F.col("n_turns"))).select(lengths["conv_id"], "n_turns", "h1", "h2"))
    whole = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # a prefix that as many conversations end with as have it is nobody's proper prefix
    having = prefixes.groupBy(F.col("place").alias("n_turns"), "h1", "h2").agg(F.count("*").alias("n_having"))
    ended = scratch.save(whole)
    proper = scratch.save(having).join(ended, ["n_turns", "h1", "h2"]).where("n_having > n_copies").select("n_turns", "h1", "h2")
    return ended.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(role: "F.Column", text: "F.Column") -> "F.Column":
    """One turn in the chat format: a role line, the text, an end mark."""
    return F.concat(
        F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n")
    )


def format_chats(
    turns: DataFrame, block_turns: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, rendered, n_turns, n_copies): the turns of maximal conversations, one row each.

    A conversation's text is its rows' rendered strings by turn.  Rows with a null conversation id are rendered each
    on their own, with null n_turns and n_copies.  An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(turns.sparkSession)
    kept = scratch.save(maximal_conversations(turns, block_turns, conv_col, turn_col, role_col, text_col))
    n = kept.count()
    own = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"),
        rendered(F.col(role_col), F.col(text_col)).alias("rendered"),
    )
    columns = ["conv_id", "turn", "role", "rendered", "n_turns", "n_copies"]
    out = own.join(sized_broadcast(kept, n, 32), "conv_id").select(columns)
    lone = own.where("conv_id is null").select(
        "conv_id", "turn", "role", "rendered", F.lit(None).cast("long").alias("n_turns"), F.lit(None).cast("long").alias("n_copies")
    )
    return out.unionByName(lone)
