"""Chat formatting at the level of tokens."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.staging import staged
from .rows import map_batches
from .sharding import numbered
from .tokens import encoder, tokenizer_path

TOKENIZER = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
# The template: <|turn|>role<|text|>text<|end|>. The ids lie beyond the tokenizer's own, so no text encodes to them.
RESERVED = {"<|turn|>": 50257, "<|text|>": 50258, "<|end|>": 50259}
TURN, TEXT, END = RESERVED.values()
# Strings that are escaped in roles and texts: the template's marks, and what other templates and tokenizers use.
CONTROL = (*RESERVED, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"

# A control string with any number of backslashes after its first character.
# None begins inside another's match, so escaping adds one backslash to each
# match and unescaping takes one from each, and they undo each other.
_MARK = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text):
    return _MARK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text):
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def assembled(encode, role, text):
    """(ids, mask) of a turn: parts encoded one by one, reserved ids put between, the mask by prefix sums of its edges."""
    parts = [[TURN], encode(escape(role)), [TEXT], encode(escape(text)), [END]]
    ids = np.concatenate([np.asarray(p, "<u4") for p in parts])
    edges = np.zeros(len(ids) + 1, np.int8)
    if role == TRAINED_ROLE:
        begin = len(ids) - 1 - len(parts[3])
        edges[begin] += 1
        edges[len(ids) - 1] -= 1
    return ids, np.cumsum(edges[:-1], dtype=np.int8)


def taken_apart(decode, ids, mask):
    """(role, text, text under the mask, formatted length) of a turn's ids, unescaped but for the length."""
    at = {mark: np.flatnonzero(ids == mark) for mark in RESERVED.values()}
    if any(len(places) != 1 for places in at.values()) or ids[0] != TURN or ids[-1] != END:
        raise ValueError("not one turn")
    split = int(at[TEXT][0])
    role, text = decode(ids[1:split]), decode(ids[split + 1 : -1])
    under = decode(ids[mask.astype(bool)])
    return unescape(role), unescape(text), unescape(under), len(role) + len(text) + sum(map(len, RESERVED))


def format_turns(turns, paths=None):
    """Turns (conv_id, turn, role, text) as tokens: one row (conv_id, position, start, ids, mask) per turn.

    position counts a conversation's turns from 0, start its tokens before the
    turn; ids are little-endian unsigned 32-bit numbers and mask has a byte per
    id, 1 where the loss counts: on an assistant's text, not on marks. Turns
    are ordered by turn (null first), then role and text; equal rows in any
    order. A null role or text is empty, a null conv_id a conversation of its
    own, an empty table gives no rows. Rows are sorted by range, and places are
    differences of running sums, so a conversation may span many tasks.
    """
    paths = paths or [tokenizer_path(name) for name in TOKENIZER]
    own = turns.select("conv_id", "turn", "role", "text")

    def start():
        encode = encoder(*paths).plain

        def work(batch):
            roles, texts = (batch.column(i).to_pylist() for i in (2, 3))
            made = [assembled(encode, r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            ids, masks = [ids.tobytes() for ids, _ in made], [mask.tobytes() for _, mask in made]
            return [batch.column(0), batch.column(1), [len(m) for m in masks], ids, masks, *_order(roles, texts)]

        return work

    fields = [*own.select("conv_id", "turn").schema, T.StructField("n", T.LongType())]
    fields += [T.StructField(n, T.BinaryType()) for n in ("ids", "mask")]
    fields += [T.StructField(n, T.BinaryType()) for n in ("by_role", "by_text")]
    # Staged, for a range sort reads its input twice.
    encoded = staged(map_batches(own, start, T.StructType(fields)))
    order = [F.col(c) for c in ("conv_id", "turn", "by_role", "by_text")]
    rows = numbered(encoded, order, "row")
    return _placed(staged(rows.drop("by_role", "by_text")))


def _order(roles, texts):
    """Sort keys: the role, and a digest of the text in place of the text."""
    digest = [hashlib.sha256((t or "").encode()).digest() for t in texts]
    return [(r or "").encode() for r in roles], digest


# Bytes of a block that is read back as a whole; a longer turn is a block by itself.
BLOCK = 1 << 20
# Rows whose tokens are added up in one task.
_BUCKET_BITS = 12


def _placed(rows):
    """Positions and starts from global row numbers: sums per bucket of rows, then within buckets."""
    bucketed = rows.withColumn("bucket", F.shiftright("row", _BUCKET_BITS))
    sums = bucketed.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("coarse", F.shiftright("bucket", _BUCKET_BITS))
    coarse = sums.groupBy("coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.selectExpr("coarse", "sum(n) over (order by coarse) - n as c0")
    fine = sums.selectExpr("bucket", "coarse", "sum(n) over (partition by coarse order by bucket) - n as b0")
    fine = fine.join(coarse, "coarse").selectExpr("bucket", "c0 + b0 as before")
    within = bucketed.selectExpr("*", "sum(n) over (partition by bucket order by row) - n as inner")
    placed = staged(within.join(fine, "bucket").withColumn("at", F.col("before") + F.col("inner")).drop("before", "inner"))
    # Where a conversation starts is found within its bucket; only the one that a bucket begins with may have started in an earlier one.
    heads = placed.groupBy("bucket").agg(F.min_by("conv_id", "row").alias("c"))
    first = placed.groupBy(F.col("conv_id").alias("d")).agg(F.min("row").alias("row0"), F.min("at").alias("at0"))
    heads = heads.join(first, F.col("c").eqNullSafe(F.col("d"))).select("bucket", "c", "row0", "at0")
    joined = placed.join(staged(heads), "bucket")
    own = Window.partitionBy("bucket", "conv_id").orderBy("row")
    carried = F.col("conv_id").eqNullSafe(F.col("c"))
    start = [F.when(carried, F.col(f"{n}0")).otherwise(F.first(n).over(own)) for n in ("row", "at")]
    return joined.select("conv_id", (F.col("row") - start[0]).alias("position"), (F.col("at") - start[1]).alias("start"), "ids", "mask")


def read_back(formatted, paths=None):
    """One row per conversation of `format_turns`: what its ids and mask hold.

    conv_id, n_turns, turns_sha256 (of role, \\n, text, \\n per turn),
    loss_chars, loss_sha256 (all text under the mask), formatted_chars. Turns
    are decoded where they lie, and neighbours joined to blocks of about
    `BLOCK` bytes there; a conversation's digests need its text in order, so its
    blocks pass one task as a stream that is hashed and not held.
    """
    paths = paths or [tokenizer_path(name) for name in TOKENIZER]

    def start():
        e = encoder(*paths)
        decode = lambda ids: e.decode(ids.tolist()).decode()

        def work(batch):
            found = [
                taken_apart(decode, np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.int8))
                for ids, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            return _joined(batch.column(0), batch.column(1).to_pylist(), found)

        return work

    kind = formatted.schema["conv_id"]
    schema = T.StructType(
        [
            kind,
            T.StructField("position", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("said", T.BinaryType()),
            T.StructField("under", T.BinaryType()),
            T.StructField("loss", T.LongType()),
            T.StructField("chars", T.LongType()),
        ]
    )
    decoded = map_batches(formatted.select("conv_id", "position", "ids", "mask"), start, schema)
    ordered = decoded.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    out = T.StructType(
        [
            kind,
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    names = [f.name for f in out]

    def digests(batches):
        held = None
        for batch in batches:
            done = []
            key = batch.column(0)
            columns = [c.to_pylist() for c in batch.columns]
            for conv, _, n, said, under, loss, chars in zip(*columns, strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        done.append(_closed(held))
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[1] += n
                held[2].update(said)
                held[3] += loss
                held[4].update(under)
                held[5] += chars
            if done:
                yield _batch(done, key.type, names)
        if held is not None:
            yield _batch([_closed(held)], key.type, names)

    return ordered.mapInArrow(digests, out)


def _joined(conversations, positions, found):
    """Columns of blocks: (conv_id, position of the first turn, turns, what they say, text under the mask, its characters, formatted characters).

    Turns that follow each other in the batch and in their conversation share a block until it is full.
    """
    names = conversations.to_pylist()
    sources, blocks, full = [], [], True
    for i, (role, text, under, chars) in enumerate(found):
        if full or names[i] != names[i - 1] or positions[i] != positions[i - 1] + 1:
            sources.append(i)
            blocks.append([positions[i], 0, [], [], 0, 0])
            size = 0
        block = blocks[-1]
        said, trained = f"{role}\n{text}\n".encode(), under.encode()
        block[1] += 1
        block[2].append(said)
        block[3].append(trained)
        block[4] += len(under)
        block[5] += chars
        size += len(said) + len(trained)
        full = size >= BLOCK
    rows = [(p, n, b"".join(said), b"".join(under), loss, chars) for p, n, said, under, loss, chars in blocks]
    return [conversations.take(pa.array(sources, pa.int64())), *(zip(*rows, strict=True) if rows else [[]] * 6)]


def _closed(held):
    return (held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5])


def _batch(rows, kind, names):
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
