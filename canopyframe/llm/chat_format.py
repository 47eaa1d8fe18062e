"""Chat formatting by grammar round trip (DataFrame functions only).

A conversation is rendered as a sequence of turns

    ### <role>:\\n<text></turn>\\n

and read back with a deterministic parser: cut at ``</turn>``, role up to the
first ``:\\n``, text after it, ``\\x`` stands for ``x``.  Every turn is first
rendered as it is, parsed, and compared with its source; a turn that does not
come back identical, or that holds a control string, is rendered again with
its control strings escaped.  Whole stretches of turns are then parsed once
more; if one differs, all its turns are escaped, and if it still differs the
job fails rather than emit a text that cannot be read back.

Defined cases: null role or text is the empty string; a null turn number sorts
first; turns with equal numbers sort by role, then text; repeated rows are
repeated turns; an empty table gives no rows; other columns are ignored.

A conversation is rendered in stretches of ``stretch`` turn numbers, so the
work on a very long conversation is shared; only its digests, which a hash
over the whole conversation needs in order, bring the stretches together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, ROLE_END, CLOSE, GAP = "### ", ":\n", "</turn>", "\n"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    """Put a backslash into every control string, and before every backslash."""
    out = _replace(text, "\\", "\\\\")
    out = _replace(out, "###", "\\###")
    return _replace(out, CLOSE, "<\\/turn>")


def escape_role(role: Column) -> Column:
    return _replace(_replace(escape(role), ":", "\\:"), "\n", "\\\n")


def unescape(text: Column) -> Column:
    """Inverse of both escapes; a text without backslash is left as it is."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _wrap(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(ROLE_END), text, F.lit(CLOSE + GAP))


def render(role: Column, text: Column, escaped: bool) -> Column:
    """One turn as text, with or without escapes."""
    return _wrap(escape_role(role), escape(text)) if escaped else _wrap(role, text)


def parse(formatted: Column) -> Column:
    """Array of (role, text) read from rendered turns; null marks text that is no turn."""
    cut = F.split(formatted, CLOSE + GAP)

    def turn(segment: Column) -> Column:
        at = F.locate(ROLE_END, segment)
        good = F.startswith(segment, F.lit(OPEN)) & (at > 0)
        skip = len(OPEN)
        role = F.substr(segment, F.lit(skip + 1), at - F.lit(skip + 1))
        text = F.substr(segment, at + F.lit(len(ROLE_END)))
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    # the last piece is what follows the last mark: empty in a well-formed text
    return F.transform(F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0))), turn)


def _holds_control(c: Column) -> Column:
    return F.contains(c, F.lit("###")) | F.contains(c, F.lit(CLOSE)) | F.contains(c, F.lit("\\"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered, escaped: each turn rendered and proven to read back."""
    turns = conversations.select(
        "conv_id", "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    plain = render(F.col("role"), F.col("text"), escaped=False)
    source = F.array(F.struct("role", "text"))
    conflict = ~F.coalesce(parse(plain) == source, F.lit(False)) | _holds_control(F.col("text")) | _holds_control(F.col("role"))
    return turns.withColumn("escaped", conflict).withColumn(
        "rendered", F.when(F.col("escaped"), render(F.col("role"), F.col("text"), escaped=True)).otherwise(plain)
    )


def format_stretches(conversations: DataFrame, stretch: int = 256) -> DataFrame:
    """conv_id, part, source, formatted, parsed: rendered stretches of conversations, parsed again and compared."""
    part = F.floor(F.col("turn") / F.lit(stretch)).cast("long")
    grouped = (
        format_turns(conversations)
        .withColumn("part", part)
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("turns"))
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    again = F.transform("turns", lambda t: render(t["role"], t["text"], escaped=True))
    first = grouped.select(
        "conv_id", "part", source.alias("source"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("first"),
        F.array_join(again, "").alias("second"),
    )
    settled = first.withColumn(
        "formatted", F.when(parse(F.col("first")) == F.col("source"), F.col("first")).otherwise(F.col("second"))
    ).withColumn("parsed", parse(F.col("formatted")))
    proven = F.when(F.col("parsed") == F.col("source"), F.col("parsed")).otherwise(
        F.raise_error(F.lit("a rendered conversation does not read back"))
    )
    return settled.select("conv_id", "part", "source", "formatted", proven.alias("parsed"))


def format_conversations(conversations: DataFrame, stretch: int = 256) -> DataFrame:
    """One row per conversation: conv_id, formatted text, and the turns and loss text read back from it."""
    said = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under_loss = F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    parts = format_stretches(conversations, stretch).select(
        "conv_id", "part", "formatted", F.size("parsed").cast("long").alias("n_turns"),
        F.array_join(said, "").alias("turns"), F.array_join(under_loss, "").alias("loss"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("part", "formatted", "turns", "loss"))).alias("parts"),
    )
    pick = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select("conv_id", "n_turns", pick("formatted").alias("formatted"), pick("turns").alias("turns_text"), pick("loss").alias("loss_text"))


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the query, read back from the formatted text."""
    return format_conversations(conversations).select(
        "conv_id", "n_turns",
        F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold every control string; the query formats it beside the table's own.
TRIAL_ID, TRIAL_TEXT = -7, "\\### Assistant: </turn> ok"


def with_trial(conversations: DataFrame) -> DataFrame:
    """The conversations and the trial conversation -7."""
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    turns = F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))))
    trial = conversations.sparkSession.range(1).select(F.explode(turns).alias("t")).select(
        F.lit(TRIAL_ID).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(TRIAL_TEXT).alias("text")
    )
    return own.unionByName(trial)
