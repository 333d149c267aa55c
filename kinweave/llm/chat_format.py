"""Chat formatting with Spark expressions only (operator 7).

The turns of a conversation are collected as structs, sorted, merged where the
role stays the same, and concatenated:

    <s><|im_start|>role
    text<|im_sep|>text of the next turn of the same role<|im_end|>
    ...</s>

Control strings inside roles and texts are broken by a backslash after their
first character, and a backslash is doubled, so every text can be read back and
no text can forge a mark. A line end inside a role is escaped as well.

The loss mask is a list of (start, length) in code points of the formatted
string: the texts of the loss role, without marks or anything between them.

A conversation's turns are one string in the end, so they are collected in one
row. Spans are summed in runs of RUN parts, so that no array is copied once for
each of its elements: work is linear in a conversation's turns but for a running
sum over the runs. Rows go by conv_id in one shuffle.

Defined results: a null text is empty; a null role is the empty role; turns are
sorted by turn (null first), then role, then text, so ties and repeated rows
have one order and all stay; rows whose conv_id is null are one conversation;
an empty table gives none; a very long text is taken whole; columns that aren't
named above, or differ by case from those that are, are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

START, ROLE, SEPARATOR, END, STOP = "<s>", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>"
#: Strings that no text may bring in as they are: this template's, and those of other common ones.
CONTROLS = [START, STOP, ROLE, SEPARATOR, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]
LOSS_ROLE = "assistant"
#: Parts whose lengths are summed one after another.
RUN = 64
#: Code points of the pieces that a formatted string is cut into, from coarse to fine, before spans are read from it.
PIECES = (1 << 22, 1 << 16, 1 << 10)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def _split_role(block: Column) -> Column:
    """Role and the rest: the role ends at the first line end that isn't escaped."""
    return F.regexp_extract(block, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)


def format_conversations(df: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, n_turns, n_blocks, formatted, loss_spans: a row for each conversation."""
    rows = pick(df, "conv_id", "turn", "role", "text")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    first = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    marked = turns.withColumn("first", first)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(F.col("first"), k + 1), F.size("turns"))
        own = F.slice("turns", start + 1, stop - start)
        return F.struct(role_at(start).alias("role"), F.transform(own, lambda t: escape(t["text"])).alias("texts"))

    blocks = marked.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.transform("first", block).alias("blocks"))
    head = lambda b: F.concat(F.lit(ROLE), _escape_role(b["role"]), F.lit("\n"))
    body = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEPARATOR), F.lit(END + "\n")))
    # Parts in order, each with its length and whether it is under the mask.
    part = lambda length, loss: F.struct(length.cast("long").alias("length"), loss.alias("loss"))
    of_block = lambda b: F.concat(
        F.array(part(F.length(head(b)), F.lit(False))),
        F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            part(F.when(i > 0, len(SEPARATOR)).otherwise(0), F.lit(False)),
            part(F.length(t), b["role"] == loss_role),
        ))),
        F.array(part(F.lit(len(END) + 1), F.lit(False))),
    )
    parts = F.concat(F.array(part(F.lit(len(START)), F.lit(False))), F.flatten(F.transform("blocks", of_block)))
    whole = F.concat(F.lit(START), F.array_join(body, ""), F.lit(STOP))
    made = blocks.select("conv_id", "n_turns", F.size("blocks").cast("long").alias("n_blocks"), whole.alias("formatted"), parts.alias("parts"))
    return made.select("conv_id", "n_turns", "n_blocks", "formatted", _loss_spans(F.col("parts")).alias("loss_spans"))


def _loss_spans(parts: Column) -> Column:
    """(start, length) of the parts under the mask: places inside each run, then each run's own place added."""
    none = F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)")
    zero = F.lit(0).cast("long")
    span = lambda start, length: F.struct(start.alias("start"), length.alias("length"))

    def inside(run: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(zero.alias("at"), none.alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + p["length"]).alias("at"),
                F.when(p["loss"], F.concat(acc["spans"], F.array(span(acc["at"], p["length"])))).otherwise(acc["spans"]).alias("spans"),
            ),
        )

    def placed(runs: Column) -> Column:
        bases = F.aggregate(
            runs,
            F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("all")),
            lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
            lambda acc: acc["all"],
        )
        return F.zip_with(runs, bases, lambda r, base: F.transform(r["spans"], lambda s: span(base + s["start"], s["length"])))

    def of_all(everything: Column) -> Column:
        last = F.floor((F.size(everything) - 1) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: inside(F.slice(everything, k * RUN + 1, F.lit(RUN))))

    # One-element arrays bind the parts and the runs, so they are computed once.
    runs = F.transform(F.array(parts), of_all)
    return F.flatten(F.flatten(F.transform(runs, placed)))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss texts, parsed from the formatted string and the mask alone."""
    inner = F.substring(F.col("formatted"), F.lit(len(START) + 1), F.length("formatted") - len(START) - len(STOP))
    literal = lambda s: "\\Q" + s + "\\E"
    chunks = F.slice(F.split(inner, literal(ROLE), -1), 2, F.greatest(F.size(F.split(inner, literal(ROLE), -1)) - 1, F.lit(0)))

    def parse(chunk: Column) -> Column:
        role = _split_role(chunk)
        rest = F.substring(chunk, F.length(role) + 2, F.length(chunk) - F.length(role) - 1 - len(END) - 1)
        return F.transform(F.split(rest, literal(SEPARATOR), -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    loss = F.flatten(F.transform(F.array(_pieces(F.array(F.col("formatted")), PIECES)), lambda cut: F.transform("loss_spans", lambda s: unescape(_span(cut, s)))))
    return formatted.select("*", F.flatten(F.transform(chunks, parse)).alias("turns"), loss.alias("loss_texts"))


def _pieces(texts: Column, sizes: tuple[int, ...]) -> Column:
    """Texts cut into pieces of sizes[-1] code points; all but the last text hold a whole number of them.

    A place in a string is found by walking there, so long strings are cut into
    long pieces first, and those into shorter ones.
    """
    for size in sizes:
        texts = F.flatten(F.transform(texts, _cutter(size)))
    return texts


def _cutter(size: int) -> Callable[[Column], Column]:
    def cut(text: Column) -> Column:
        last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * size + 1, F.lit(size)))

    return cut


def _span(cut: Column, s: Column) -> Column:
    """The text of a span of a string that is cut into pieces."""
    size = PIECES[-1]
    low, high = (F.floor(x / size).cast("int") for x in (s["start"], s["start"] + s["length"]))
    around = F.array_join(F.slice(cut, low + 1, high - low + 1), "")
    return F.substring(around, (s["start"] - low * size + 1).cast("int"), s["length"].cast("int"))
