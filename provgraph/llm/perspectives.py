"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once: that
speaker's turns as ``assistant``, everybody else's as ``user`` turns that carry
the speaker's name.  The mask covers what the assistant is to learn: the
content of its turns and the end marker.

A participant is the raw role, whatever it holds.  Only its printed name is escaped, one to one
(``name_of``), so that names stay apart and none can forge a marker or a line.  In a text ``<``, backslashes, ``|`` gets
one backslash more (``<|`` becomes ``<\\|``); ``restored`` takes it back exactly.

``rotate`` returns one row per (conversation, perspective, turn) with the place of the turn in
the rendered dialogue.  No conversation is gathered, of whatever length or share of the rows: turns are sorted
into ranges of (conversation, turn), each range adds up its own segments, and the sums before a range are
carried over from the ranges' totals.  Turns are joined with the conversation's distinct participants
(Spark splits a hot conversation, since both sides are plain scans and only the join needs its key).
``render`` joins the segments to dialogues, in pieces of ``PIECE`` code points: a piece holds the segments that start in
it, so a group's size is bounded too.

Cases: a null role is a participant of its own (printed ``%null``), an empty one too (``%empty``); a null text is an empty turn, one of any
length a segment of its own; a null conversation id or turn is kept as such (null ids count as one
conversation, null turns come first); of equal turn numbers (ties) the order is by role, then text, nulls first; repeated turns are kept as
rows of their own.  Empty tables give empty results and further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PIECE = 1 << 16
#: What a printed name may not hold, ``%`` first.
ESCAPES = {"%": "%25", "<": "%3C", "|": "%7C", ">": "%3E", "\n": "%0A", "\r": "%0D"}


def name_of(role: Column) -> Column:
    """The printed name of a raw role; different roles have different names."""
    name = role
    for sign, code in ESCAPES.items():
        name = F.replace(name, F.lit(sign), F.lit(code))
    return F.when(role.isNull(), "%null").when(role == "", "%empty").otherwise(name)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def restored(content: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(content, r"<\\(\\*)\|", r"<$1|")


def placed_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns in the shared folder, sorted into ranges ``part``, each with its place ``at`` there."""
    order = ["conv_id", "turn", "role", "content"]
    turns = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    ranges = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return stored(placed.withColumn("part", F.shiftright(number, 33)).withColumn("at", number), "turns")


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, perspective, turn, rendered_role, speaker, rendered, start, mask_start, mask_len``.

    ``rendered`` is the turn's whole segment, ``start`` its first code point in the dialogue (0-based);
    from ``mask_start``, counted in the dialogue too, ``mask_len`` code points are trained on (0 for other speakers).
    """
    turns = placed_turns(conversations, conv, turn, role, text)
    views = stored(turns.select(F.col("conv_id").alias("view_conv"), F.col("role").alias("view")).distinct(), "views")
    own = F.col("role").eqNullSafe(F.col("view"))
    mine, other = f"{OPEN}assistant\n", f"{OPEN}user name="
    # Places are found without the texts: sizes, joined with the participants.
    sizes = turns.select("conv_id", "role", "part", "at", (F.length("content") + len(CLOSE)).alias("body"), (F.length(name_of(F.col("role"))) + len(other) + 1).alias("head"))
    each = sizes.join(views, sizes.conv_id.eqNullSafe(views.view_conv)).select("conv_id", "view", "part", "at", own.alias("own"), (F.when(own, len(mine)).otherwise(F.col("head")) + F.col("body")).cast("long").alias("size"))
    # Sums within a range, and the totals of the ranges before it: as many rows as (range, conversation, view).
    totals = each.groupBy("part", "conv_id", "view").agg(F.sum("size").alias("size"))
    before = totals.select("part", "conv_id", "view", (F.sum("size").over(Window.partitionBy("conv_id", "view").orderBy("part")) - F.col("size")).alias("before"))
    within = F.sum("size").over(Window.partitionBy("part", "conv_id", "view").orderBy("at")) - F.col("size")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("part", "conv_id", "view")]
    placed = each.withColumn("within", within).alias("e").join(before.alias("b"), same[0] & same[1] & same[2]).select("at", "e.view", "own", (F.col("within") + F.col("before")).alias("start"))
    head = F.when(F.col("own"), F.lit(mine)).otherwise(F.concat(F.lit(other), name_of(F.col("role")), F.lit("\n")))
    return turns.join(placed, "at").select(
        "conv_id",
        name_of(F.col("view")).alias("perspective"),
        "turn",
        F.when(F.col("own"), "assistant").otherwise("user").alias("rendered_role"),
        name_of(F.col("role")).alias("speaker"),
        F.concat(head, F.col("content"), F.lit(CLOSE)).alias("rendered"),
        "start",
        (F.col("start") + F.length(head)).alias("mask_start"),
        F.when(F.col("own"), F.length("content") + len(CLOSE)).otherwise(0).cast("long").alias("mask_len"),
    )


def render(rotated: DataFrame, piece: int = PIECE) -> DataFrame:
    """Whole dialogues in pieces: ``conv_id, perspective, piece, start, dialogue, masks``; ``piece`` counts by ``start`` in
    steps of so many code points, ``start`` is the first of the piece's segments, ``masks`` lists the masked code
    points of the dialogue as ``start:length``, joined by commas."""
    turns = F.array_sort(F.collect_list(F.struct("start", "rendered", "mask_start", "mask_len")))
    grouped = rotated.groupBy("conv_id", "perspective", F.floor(F.col("start") / piece).cast("long").alias("piece")).agg(turns.alias("turns"))
    return grouped.select(
        "conv_id",
        "perspective",
        "piece",
        F.col("turns")[0]["start"].alias("start"),
        F.expr("array_join(transform(turns, t -> t.rendered), '')").alias("dialogue"),
        F.expr("array_join(transform(filter(turns, t -> t.mask_len > 0), t -> concat(t.mask_start, ':', t.mask_len)), ',')").alias("masks"),
    )
