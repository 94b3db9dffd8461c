"""Chat formatting with Spark expressions alone.

The template of a message is ``### Role: text</turn>`` and a line feed. Adjacent turns of one role are
one message; their texts are parted by ``<join/>``. These control strings, and the backslash, are
escaped in texts (and the colon in unknown roles), so that every turn can be read back.

Defined cases: a null role or text is empty; turns are ordered by turn, then role, then text, nulls
first, so ties and repeated rows are kept in a fixed order; rows with a null conv_id are one
conversation; an empty table gives no rows; other columns are ignored, whatever their names. Work on a
conversation grows with its text and, for the spans, with its turns to the power 1.5.

The one group that meets in a task is a conversation, which is also one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "system")
TURN_START, TURN_END, JOIN = "### ", "</turn>\n", "<join/>"
#: Control string in a text, and what stands for it. The backslash comes first on the way in and last on the way out.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("<join/>", "\\j"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, table=ESCAPES) -> Column:
    for plain, code in table:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, table=ESCAPES) -> Column:
    for plain, code in reversed(table):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _shown(role: Column) -> Column:
    """Known roles by name, others behind an equals sign."""
    out = F.concat(F.lit("="), escape(role, ROLE_ESCAPES))
    for r in ROLES:
        out = F.when(role == r, F.lit(r.capitalize())).otherwise(out)
    return out


def _read_role(shown: Column) -> Column:
    out = unescape(F.substr(shown, F.lit(2)), ROLE_ESCAPES)
    for r in ROLES:
        out = F.when(shown == r.capitalize(), F.lit(r)).otherwise(out)
    return out


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_spans array of (start, length) in code points from 0.

    The spans cover the escaped text of each assistant turn and nothing else.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # Where a role differs from the one before, a message begins; it takes all turns up to the next beginning.
    n = F.size("t")
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", i - 2)["role"]))
    ends = F.concat(F.slice("begins", F.lit(2), n), F.array(n + 1))

    def message(begin: Column, end: Column) -> Column:
        role = F.get("t", begin - 1)["role"]
        return F.struct(
            F.concat(F.lit(TURN_START), _shown(role), F.lit(": ")).alias("head"),
            F.transform(F.slice("t", begin, end - begin), lambda x: escape(x["text"])).alias("bodies"),
            (role == "assistant").alias("loss"),
        )

    def parts(m: Column, k: Column) -> Column:
        first = F.length(m["head"]) + F.when(k > 0, len(TURN_END)).otherwise(0)
        return F.transform(
            m["bodies"],
            lambda body, j: F.struct(
                F.when(j == 0, first).otherwise(len(JOIN)).cast("long").alias("skip"), F.length(body).cast("long").alias("length"), m["loss"].alias("loss")
            ),
        )

    whole = F.array_join(F.transform("m", lambda m: F.concat(m["head"], F.array_join(m["bodies"], JOIN), F.lit(TURN_END))), "")
    found = (
        grouped.select("conv_id", "t", begins.alias("begins")).select("conv_id", "t", "begins", ends.alias("ends"))
        .select("conv_id", F.zip_with("begins", "ends", message).alias("m"))
        .select("conv_id", whole.alias("formatted"), F.flatten(F.transform("m", parts)).alias("p"))
    )
    return _spans(found).select("conv_id", "formatted", "loss_spans")


def _spans(found: DataFrame) -> DataFrame:
    """loss_spans from p, an array of what stands before each body, its length, and whether it is under the loss.

    The running sum goes by blocks of the square root of all parts, as an array that grows by one is copied each time.
    """
    width = F.ceil(F.sqrt(F.size("p"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size("p"), F.col("width")), lambda i: F.slice("p", i, F.col("width")))
    size = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, x: acc + x["skip"] + x["length"])
    offsets = F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda acc, block: F.array_append(acc, F.element_at(acc, -1) + size(block)))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + x["skip"]
        span = F.struct(begin.alias("start"), x["length"].alias("length"))
        return F.struct((begin + x["length"]).alias("pos"), F.when(x["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.transform("blocks", lambda block, i: F.aggregate(block, F.struct(F.get("offsets", i).alias("pos"), none.alias("spans")), step, lambda acc: acc["spans"]))
    return found.withColumn("width", width).withColumn("blocks", blocks).withColumn("offsets", offsets).withColumn("loss_spans", F.flatten(spans))


def read_turns(formatted: Column) -> Column:
    """array of (role, text), read back from the formatted string."""
    messages = F.filter(F.split(formatted, TURN_END), lambda m: m != "")

    def turns(m: Column) -> Column:
        colon = F.instr(m, ": ")
        role = _read_role(F.substr(m, F.lit(len(TURN_START) + 1), colon - len(TURN_START) - 1))
        bodies = F.split(F.substr(m, colon + 2), JOIN)
        return F.transform(bodies, lambda b: F.struct(role.alias("role"), unescape(b).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what can be read back from the formatted conversations."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
