"""Operator 13: reply trees formatted as chat conversations.

Messages (tree, id, parent, role, text, score) form trees. Every message first
learns, by self-joins that double the distance to the ancestor it knows, its
depth, the sum of scores and the number of formatted code points on its way from the
root: a chain of n messages takes log2(n) joins. Leaves end a branch each; the
branches of a tree are ranked by mean score (ties: smaller leaf id), and the messages of the ``top`` chosen
ones are listed by the same joins backwards. Only ids and numbers move in these
joins; texts are joined once, to the listed messages.

The template marks a turn as ``<turn ROLE>``, newline, text, newline, ``</turn>``,
newline. In texts a backslash is put before every backslash, ``<turn `` and ``</turn>``; in roles
before every backslash, ``<`` and ``>``. So a mark never occurs inside a text, and
``unescape`` gives back what was there.

The output is a table of pieces: whole turns of a branch, about ``piece_chars`` code points
to a piece (a turn is never cut), each with its text and its loss mask, the
code point spans of the trained role's texts. Ordinary conversations are one piece; of a
conversation of any length no task ever holds more than a piece.

Defined results: a null text or role is empty, a null score 0. A parent that is null or not in the tree
makes its message a root. Messages on or below a circle of parents have no root and are in
no branch (``circular``). Rows that repeat (tree, id) are one message, the least of them by
(parent, role, text, score). A null tree is a tree of its own; a null id is an id
that nobody replies to. Other columns are not read; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.llm.common import in_arrow, saved

#: fixed values: the template
OPEN, NAMED, CLOSE = "<turn ", ">\n", "\n</turn>\n"
MARKS = r"(\\|<turn |</turn>)"
ROLE_MARKS = r"([\\<>])"
HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
PIECE_CHARS = 1 << 20


def escaped(text: str | Column, marks: str = MARKS) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), marks, r"\\$1")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def one_row_each(messages: DataFrame) -> DataFrame:
    rest = [c for c in ("parent", "role", "text", "score") if c in messages.columns]
    return messages.groupBy("tree", "id").agg(F.min(F.struct(*rest)).alias("m")).select("tree", "id", *[F.col(f"m.{c}").alias(c) for c in rest])


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Trees:
    """What the doubling joins have found.

    ``ways``: tree, id, depth (messages from the root on, itself included), score (sum), chars
    (code points up to its end), own. ``jumps[k]``: tree, id, up (ancestor 2^k above).
    ``circular``: messages without a root.
    """

    def __init__(self, messages: DataFrame):
        turn = F.lit(len(OPEN) + len(NAMED) + len(CLOSE)) + F.length(escaped("role", ROLE_MARKS)) + F.length(escaped("text"))
        score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
        now = saved(messages.select("tree", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), score.alias("score"),
                                    turn.cast("long").alias("chars"), turn.cast("long").alias("own")), "ways")
        total, far = now.count(), 1
        self.jumps: list[DataFrame] = []
        done = [now.where(F.col("up").isNull())]
        open_ = now.where(F.col("up").isNotNull())
        while total:
            every = open_.union(done[0])
            for d in done[1:]:
                every = every.union(d)
            above = every.select(*[F.col(c).alias(f"a_{c}") for c in ("tree", "id", "up", "depth", "score", "chars")])
            met = open_.join(above, same("tree", "a_tree") & (F.col("up") == F.col("a_id")), "left")
            # a parent that isn't there ends the way
            add = {c: (F.col(c) + F.coalesce(F.col(f"a_{c}"), F.lit(0))).alias(c) for c in ("depth", "score", "chars")}
            met = saved(met.select("tree", "id", F.col("a_id").alias("near"), F.col("a_up").alias("up"), *add.values(), "own"), "ways")
            state = met.drop("near").select(*now.columns)
            self.jumps.append(met.where(F.col("near").isNotNull()).select("tree", "id", F.col("near").alias("up")))
            done.append(state.where(F.col("up").isNull()))
            open_ = state.where(F.col("up").isNotNull())
            far *= 2
            if far > total or open_.isEmpty():
                break
        self.circular = open_.select("tree", "id") if total else now.select("tree", "id")
        self.ways = done[0]
        for d in done[1:]:
            self.ways = self.ways.union(d)
        self.messages = messages

    def branches(self) -> DataFrame:
        """(tree, leaf, n_turns, score, last): a row for each root-to-leaf path; last: code points before the leaf."""
        asked = self.messages.where(F.col("parent").isNotNull()).select(F.col("tree").alias("p_tree"), F.col("parent").alias("p_id")).distinct()
        leaves = self.ways.join(asked, same("tree", "p_tree") & (F.col("id") == F.col("p_id")), "left_anti")
        return leaves.select("tree", F.col("id").alias("leaf"), F.col("depth").alias("n_turns"), (F.col("score") / F.col("depth")).alias("score"),
                             (F.col("chars") - F.col("own")).alias("last"))

    def best(self, top: int = 1) -> DataFrame:
        """The ``top`` branches of each tree; Spark keeps as many of each tree in every task before it moves them."""
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        return self.branches().withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top)

    def listed(self, branches: DataFrame) -> DataFrame:
        """(tree, branch, last, id): every message of the given branches."""
        rows = saved(branches.select("tree", "branch", "last", F.col("leaf").alias("id")), "paths")
        for jump in reversed(self.jumps):
            up = jump.select(F.col("tree").alias("j_tree"), F.col("id").alias("j_id"), F.col("up").alias("j_up"))
            more = rows.join(up, same("tree", "j_tree") & same("id", "j_id"))
            rows = saved(rows.union(more.select("tree", "branch", "last", F.col("j_up").alias("id"))), "paths")
        return rows


def formatted(messages: DataFrame, top: int = 1, trained: str = "assistant", piece_chars: int = PIECE_CHARS, repeated: bool = True) -> DataFrame:
    """The chosen branches as pieces: tree, branch, piece, last_piece, n_turns, text, loss
    (array of start, end in the piece's code points). ``repeated=False``: no (tree, id) repeats."""
    messages = saved(one_row_each(messages) if repeated else messages, "messages")
    trees = Trees(messages)
    listed = trees.listed(trees.best(top)).withColumnsRenamed({"tree": "b_tree", "id": "b_id"})
    ways = trees.ways.select(F.col("tree").alias("w_tree"), F.col("id").alias("w_id"), "depth", (F.col("chars") - F.col("own")).alias("at"))
    on = same("b_tree", "w_tree") & same("b_id", "w_id")
    turns = listed.join(ways, on).join(messages.select("tree", "id", "role", "text"), same("b_tree", "tree") & same("b_id", "id"))
    head = F.concat(F.lit(OPEN), escaped("role", ROLE_MARKS), F.lit(NAMED))
    body = escaped("text")
    start = F.col("at") + F.length(head)
    span = F.when(F.col("role") == trained, F.struct(start.cast("long").alias("start"), (start + F.length(body)).cast("long").alias("end")))
    piece = (turns.select("tree", "branch", F.expr(f"`at` div {piece_chars}").alias("piece"), F.expr(f"`last` div {piece_chars}").alias("last_piece"),
                          F.struct("depth", "at", F.concat(head, body, F.lit(CLOSE)).alias("turn"), span.alias("span")).alias("t"))
             .groupBy("tree", "branch", "piece", "last_piece").agg(F.array_sort(F.collect_list("t")).alias("t")))
    base = F.col("t")[0]["at"]
    spans = F.filter("t.span", lambda s: s.isNotNull())
    return piece.select("tree", "branch", "piece", "last_piece", F.size("t").cast("long").alias("n_turns"), F.array_join("t.turn", "").alias("text"),
                        F.transform(spans, lambda s: F.struct((s["start"] - base).alias("start"), (s["end"] - base).alias("end"))).alias("loss"))


def turns_in(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted piece."""
    at = 0
    while at < len(text):
        head = HEAD.match(text, at)
        end = text.index(CLOSE, head.end())
        yield unescape(head[1]), unescape(text[head.end(): end])
        at = end + len(CLOSE)


DIGEST = "tree {}, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Per formatted branch, parsed from its pieces: n_turns, sha256 of role, newline, text, newline of all turns,
    number and sha256 of the code points under the loss mask (unescaped), formatted code points.

    Branches of one piece are read where they are. The pieces of longer ones are sorted and
    streamed, a piece in memory at a time (a sha256 can't be put together from parts).
    """
    kind = pieces.schema["tree"].dataType.simpleString()

    def run(batches):
        now, state = None, None

        def row():
            (tree, branch), (n, turns, chars, loss, size) = now, state
            return tree, branch, n, turns.hexdigest(), chars, loss.hexdigest(), size

        names = ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out, schema = [], batch.schema.field("tree").type
            for tree, branch, text, loss in zip(*(batch.column(c) for c in ("tree", "branch", "text", "loss")), strict=True):
                key = (tree.as_py(), branch.as_py())
                if key != now:
                    if state:
                        out.append(row())
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = text.as_py()
                for role, said in turns_in(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss.as_py():
                    said = unescape(text[span["start"]: span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield _rows(out, names, schema)
        if state:
            yield _rows([row()], names, schema)

    read = pieces.select("tree", "branch", "piece", "last_piece", "text", "loss")
    long = read.where(F.col("last_piece") > 0).repartition("tree", "branch").sortWithinPartitions("tree", "branch", "piece")
    return read.where(F.col("last_piece") == 0).union(long).drop("last_piece").transform(in_arrow, run, DIGEST.format(kind))


def _rows(rows: list[tuple], names: list[str], tree: pa.DataType) -> pa.RecordBatch:
    kinds = [tree, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def replies(conversations: DataFrame) -> DataFrame:
    """Chains as reply trees: (tree, id, parent, role, text) of rows (conv_id, turn, role, text), where every row
    answers the one before it by turn (ties: role, md5 of the text).

    Rows are numbered over the whole table by a range sort, so one very long conversation is dealt
    over many tasks; rows equal in all four columns are told apart by the columns file and row, if the table has them.
    """
    tie = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    place = [c for c in ("file", "row") if c in conversations.columns]
    order = ["conv_id", "turn", "role", "tie", *place]
    rows = conversations.select("conv_id", "turn", "role", "text", tie.alias("tie"), *place).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = saved(rows.select("conv_id", "role", "text"), "turns")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    counts = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    counts = counts.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rows = rows.select("conv_id", "role", "text", part.alias("part"), F.col("_metadata.row_index").alias("at"))
    rows = rows.join(counts, F.col("part") == F.col("p")).select("conv_id", "role", "text", (F.col("ahead") + F.col("at")).alias("id"))
    first = rows.groupBy("conv_id").agg(F.min("id").alias("first")).withColumnRenamed("conv_id", "of")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")))
    return rows.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > F.col("first"), F.col("id") - 1).alias("parent"), "role", "text")
