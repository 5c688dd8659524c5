"""Chat formatting in budgeted windows of whole turns.

A turn is written ``<s>role\\ntext</s>``.  Inside roles and texts ``~``, ``<``
and ``[`` (and a role's line ends) are escaped as ``~0 ~1 ~2 ~3``, so that no
control string (``<s>``, ``</s>``, ``[INST]`` and the like) can occur there, and
reading back is exact.

Windows are spans of turns.  The tokens of a turn (pieces of letters and digits,
single signs, and ``TURN_TOKENS``) are summed in order, and a window ends before
the turn that would exceed the budget left by the system turn and the history.
A later window repeats the system turn and the last turns before it, at most
``HISTORY_TURNS`` of at most ``HISTORY_TOKENS`` tokens.  Only assistant texts
that are new in a window are under its loss mask; repeated ones are masked.  A
turn longer than the budget has a window of its own; no text is cut.

No conversation is gathered in one place: turns are numbered across sorted
ranges, tokens (numbers alone) are summed in blocks of ``BLOCK_TURNS`` turns, at
whose ends windows end too, and texts come together within a window.  Only
``read_back`` joins the whole text of a conversation, as its digest needs it.

Only DataFrame functions are used.  Defined results: a null role or text is
empty; repeated rows are turns of their own; turns of equal number are ordered
by role and text; rows of a null conv_id are one conversation; other columns
are ignored; an empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import settle

BUDGET, HISTORY_TURNS, HISTORY_TOKENS, TURN_TOKENS = 1024, 2, 256, 4
BLOCK_TURNS = 1024           # a window also ends where a block of so many turns ends
OPEN, CLOSE = "<s>", "</s>"
# fixed control characters and their escapes; "~" first when writing, last when reading
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
USES = "array<struct<idx:bigint,window:int,again:boolean>>"
PIECES = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def escape(c) -> F.Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c) -> F.Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c



def windows(chats: DataFrame, budget: int = BUDGET, id_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, window, text, repeated, loss)``: the formatted text, how
    many of its turns are repeated, and the loss mask as ``(start, length)``
    spans in code points."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = chats.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), (role == "assistant").alias("target"), (role == "system").alias("system"),
        F.replace(escape(role), F.lit("\n"), F.lit("~3")).alias("role"), escape(text).alias("text"), text.alias("raw"))
    t, blocks = _numbered(rows)
    # the window of every turn of a block: tokens summed until the budget is reached
    cap = F.lit(budget) - F.lit(HISTORY_TOKENS) - F.col("lead") * F.col("lead_tokens")
    blocks = blocks.withColumn("cap", cap)
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("ws"))

    def step(acc, tokens):
        new = (acc["used"] > 0) & (acc["used"] + tokens > F.col("cap"))
        w = F.when(new, acc["w"] + 1).otherwise(acc["w"])
        return F.struct(w.alias("w"), F.when(new, tokens).otherwise(acc["used"] + tokens).alias("used"), F.concat(acc["ws"], F.array(w)).alias("ws"))

    blocks = blocks.withColumn("ws", F.aggregate("tokens", start, step, lambda acc: acc["ws"]))
    order = Window.partitionBy("conv_id").orderBy("block")
    blocks = (blocks.withColumn("first", F.coalesce(F.sum(F.element_at("ws", -1) + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("back", F.concat(F.coalesce(F.lag(F.slice("tokens", -F.least(F.lit(HISTORY_TURNS), F.size("tokens")), HISTORY_TURNS)).over(order),
                                                      F.array().cast("array<int>")), "tokens"))
              .withColumn("n_back", F.size("back") - F.size("tokens")))
    base = F.col("block") * BLOCK_TURNS

    def uses(w, i):
        """The turns that turn i of the block (from 0) brings into its window:
        itself, and the system turn and the history if it is the first there."""
        at = base + i
        room = F.greatest(at - F.col("lead"), F.lit(0))            # turns before it, without the system turn
        h = F.lit(0)
        for take in range(1, HISTORY_TURNS + 1):
            used = F.lit(0)
            for k in range(1, take + 1):
                used = used + F.get("back", F.col("n_back") + i - k)
            h = F.when((room >= take) & (used <= HISTORY_TOKENS), take).otherwise(h)
        window = (F.col("first") + w).cast("int")
        use = lambda idx, repeated: F.struct(idx.cast("bigint").alias("idx"), window.alias("window"), F.lit(repeated).alias("again"))
        head = F.concat(F.when(F.col("lead") == 1, F.array(use(F.lit(0), True))).otherwise(F.array().cast(USES)),
                        F.transform(F.slice(F.array(*[F.lit(k) for k in range(1, HISTORY_TURNS + 1)]), F.lit(1), h), lambda k: use(at - k, True)))
        opens = (at > 0) & ((i == 0) | (w != F.get("ws", F.greatest(i - 1, F.lit(0)))))
        return F.concat(F.when(opens, head).otherwise(F.array().cast(USES)), F.array(use(at, False)))

    used = (blocks.select("conv_id", "salts", F.explode(F.flatten(F.transform("ws", uses))).alias("u"))
            .select("conv_id", "u.*", F.when(F.col("u.idx") == 0, F.pmod("u.window", "salts")).otherwise(F.lit(0)).alias("salt")))
    # a system turn is repeated in every window: in a long conversation it is dealt to several tasks
    texts = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("idx") == 0, F.col("salts") - 1).otherwise(0)))).select(
        F.col("conv_id").alias("__id"), F.col("idx").alias("__idx"), F.col("salt").alias("__salt"),
        F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)).alias("piece"), (F.length("role") + len(OPEN) + 1).alias("skip"),
        F.length("text").alias("length"), "target")
    w = (used.join(texts, F.col("conv_id").eqNullSafe(F.col("__id")) & (F.col("idx") == F.col("__idx")) & (F.col("salt") == F.col("__salt")))
         .groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("idx", "again", "piece", "skip", "length", "target"))).alias("all")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("all", none, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["piece"])).alias("at"),
        F.when(x["target"] & ~x["again"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), x["length"].alias("length")))))
        .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    return w.select("conv_id", "window", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("text"),
                    F.size(F.filter("all", lambda x: x["again"])).alias("repeated"), spans.alias("loss"))


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their place ``idx`` in the conversation, and per block of
    turns ``(conv_id, block, tokens, lead, lead_tokens, salts)``, numbers only.

    Turns are sorted into ranges, so that a conversation may lie in many tasks;
    places are those within a range plus the counts of the ranges before."""
    keys = ("conv_id", "turn", "role", "text")
    # the ranges' sample, which the driver holds, has the beginnings of texts only
    rows = rows.repartitionByRange(*keys[:-1], F.substring("text", 1, 32)).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    rows = settle(rows.withColumn("tokens", F.regexp_count("raw", F.lit(PIECES)) + TURN_TOKENS).drop("raw"))
    rows = rows.withColumn("part", F.shiftright("pos", 33))
    order = Window.partitionBy("conv_id").orderBy("part")
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos0"),
                                                F.min_by(F.struct("system", "tokens"), "pos").alias("top"))
    top, total = F.first("top").over(order), F.sum("n").over(Window.partitionBy("conv_id"))
    parts = parts.select(F.col("conv_id").alias("__id"), F.col("part").alias("__part"), "pos0", (F.sum("n").over(order) - F.col("n")).alias("before"),
                         top["system"].cast("int").alias("lead"), top["tokens"].alias("lead_tokens"),
                         F.least(F.lit(64), F.floor(total / BLOCK_TURNS) + 1).cast("int").alias("salts"))
    t = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("__id")) & (F.col("part") == F.col("__part"))).withColumn(
        "idx", F.col("before") + F.col("pos") - F.col("pos0"))
    blocks = (t.withColumn("block", F.floor(F.col("idx") / BLOCK_TURNS)).groupBy("conv_id", "block")
              .agg(F.array_sort(F.collect_list(F.struct("idx", "tokens"))).alias("all"), F.first("lead").alias("lead"),
                   F.first("lead_tokens").alias("lead_tokens"), F.first("salts").alias("salts")))
    return t, blocks.withColumn("tokens", F.transform("all", lambda x: x["tokens"])).drop("all")


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns, loss, formatted_chars)`` of each
    conversation, read from the windows' text and mask alone: ``turns`` is
    role, line end, text, line end of every turn that is new in its window."""
    pieces = F.filter(F.split("text", CLOSE), lambda p: p != "")
    f = formatted.withColumn("new", F.slice(pieces, F.col("repeated") + 1, F.greatest(F.size(pieces) - F.col("repeated"), F.lit(0))))

    def turn(p):
        body = F.substr(p, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.concat(unescape(F.replace(role, F.lit("~3"), F.lit("\n"))), F.lit("\n"), unescape(F.substr(body, F.length(role) + 2)), F.lit("\n"))

    f = f.select("conv_id", "window", F.size("new").cast("bigint").alias("n"), F.array_join(F.transform("new", turn), "").alias("turns"),
                 F.array_join(F.transform("loss", lambda s: unescape(F.substr("text", s["start"] + 1, s["length"]))), "").alias("loss"),
                 F.length("text").cast("bigint").alias("chars"))
    g = f.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                 F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"))
    return g.select("conv_id", "n_turns", F.array_join(F.transform("all", lambda x: x["turns"]), "").alias("turns"),
                    F.array_join(F.transform("all", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")


def digests(formatted: DataFrame) -> DataFrame:
    r = read_back(formatted)
    return r.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
