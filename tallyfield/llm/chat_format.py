"""Chat formatting by perspective rotation; DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
the others as named users; the mask lists the character spans of the assistant's own turns, which are
what a model would be trained on.  Texts and roles are escaped, so none of them can forge a marker.

A conversation may hold any share of all turns, so it is rendered in segments of ``TURNS`` turn numbers,
each a bounded row with its ``offset`` in the participant's whole rendering: the segments of a
participant in order, one after the other, are the whole dialogue, and mask spans plus offset are the
spans in it.  Most conversations have one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURNS = 256
NARRATORS = ("system",)  # roles that aren't participants: rendered as they are
END = "<|end|>"


def escaped(text: Column) -> Column:
    """No ``<|`` is left: one more backslash between the signs; taking one out gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def named(role: Column) -> Column:
    """A role for a marker: per cent codes for the signs that would end it."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")), F.lit("\n"), F.lit("%0A"))


def rotate(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, segment, offset, participant, text, mask, n_turns, n_masked.

    ``conversations`` has conv_id, turn, role, text; other columns aren't read.  Turns are in order of
    (turn, role, text), nulls first; a row that is repeated is rendered as often.  A null text is empty,
    a null role is a participant called "unknown", null turns make segment -1, a null conv_id is a
    conversation of its own.  A conversation of narrators alone has no participant and no row; a
    participant has a row for each segment, with an empty mask where it says nothing.  ``mask`` is an
    array of (start, end), code points in ``text``; ``offset`` counts code points too.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / turns).cast("long"), F.lit(-1)))
    said = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    people = rows.where(~F.col("role").isin(*NARRATORS)).select(F.col("conv_id").alias("of"), F.col("role").alias("participant")).distinct()
    segments = rows.select("conv_id", "segment").distinct()

    user = F.concat(F.lit("<|user:"), named(F.col("role")), F.lit("|>\n"))
    narrator = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    assistant = "<|assistant|>\n"
    plain = F.length(F.when(F.col("role").isin(*NARRATORS), narrator).otherwise(user))
    # lengths of the segments: as every speaker's user turns, and what a participant's own turns change
    whole = rows.groupBy("conv_id", "segment").agg(F.sum(plain + F.length("text") + len(END) + 1).alias("size"))
    own = rows.groupBy("conv_id", "segment", "role").agg(F.sum(F.lit(len(assistant)) - plain).alias("change"))
    seen = segments.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    same = lambda a, b, *more: a.join(b.select([F.col(c).alias(f"x_{c}") for c in b.columns]), [F.col("conv_id").eqNullSafe(F.col("x_conv_id")), F.col("segment") == F.col("x_segment"), *more], "left")
    sized = same(same(seen, whole).select("conv_id", "segment", "participant", F.col("x_size").alias("size")), own, F.col("participant") == F.col("x_role"))
    upto = Window.partitionBy("conv_id", "participant").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.select("conv_id", "segment", "participant", (F.col("size") + F.coalesce("x_change", F.lit(0))).alias("size"))
    placed = sized.withColumn("offset", F.coalesce(F.sum("size").over(upto), F.lit(0)).cast("long"))
    both = same(placed, said).withColumnRenamed("x_said", "said")

    me = F.col("participant")
    head = lambda t: F.when(t["role"].isin(*NARRATORS), F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))).when(t["role"] == me, F.lit(assistant)).otherwise(F.concat(F.lit("<|user:"), named(t["role"]), F.lit("|>\n")))
    parts = F.transform("said", lambda t: F.struct((t["role"] == me).alias("own"), head(t).alias("head"), t["text"].alias("text")))
    both = both.select("conv_id", "segment", "offset", "participant", parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END + "\n"))), "")
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    begin = F.struct(F.lit(0).cast("long").alias("at"), spans.alias("mask"))

    def step(s, p):
        start = s["at"] + F.length(p["head"])
        end = start + F.length(p["text"]) + len(END)
        mine = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(s["mask"], mine)).otherwise(s["mask"]).alias("mask"))

    both = both.withColumn("mask", F.aggregate("parts", begin, step)["mask"])
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"])
    return both.select("conv_id", "segment", "offset", "participant", text.alias("text"), "mask", F.size("parts").cast("long").alias("n_turns"), masked.alias("n_masked"))
