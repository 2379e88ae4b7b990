import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brisktill.llm import chat
from brisktill.llm.queries import QUERIES
from brisktill.llm.tokens import Encoder, tokenizer_path

KIND = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(*[tokenizer_path(n) for n in chat.TOKENIZER])


def expected(rows):
    """{conv_id: (n_turns, turns digest, loss_chars, loss digest)} of sorted rows."""
    held = {}
    for conv, _, role, text in rows:
        held.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    out = {}
    for conv, turns in held.items():
        loss = [t for r, t in turns if r == "assistant"]
        out[conv] = (len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), sha(loss))
    return out


def test_query_round_trips(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op9_chat_format"](spark, folder).collect()}
    wanted = expected(sorted(rows))
    assert {k: v[:4] for k, v in found.items()} == wanted
    marks = sum(map(len, chat.RESERVED))
    for conv, value in found.items():
        assert value[4] == sum(len(chat.escape(r)) + len(chat.escape(t)) + marks for c, _, r, t in rows if c == conv)


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    pool = [*chat.CONTROL, "\\", "\\\\", "<", "|", ">", "[", "]", "a", "<\\|turn|>", "<\\\\/s>", "/INST"]
    for _ in range(5000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 10)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_mask_covers_the_text_of_the_trained_role(encoder):
    for role in ("assistant", "user", "", "tool"):
        for text in ("", "hi", "a <|end|> b", "é日本😀"):
            ids, mask = chat.assembled(encoder.plain, role, text)
            decode = lambda x: encoder.decode(x.tolist()).decode()
            assert chat.taken_apart(decode, ids, mask)[:3] == (role, text, text if role == "assistant" else "")
            assert mask.sum() == (len(encoder.plain(chat.escape(text))) if role == "assistant" else 0)
            assert (ids[mask == 1] < chat.TURN).all()


def test_awkward_rows(spark, frame):
    long = " ".join(["word", "</s>", "[INST]"] * 20_000)
    rows = [
        (1, None, "user", "first"), (1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "no role"), (1, 1, "assistant", ""),
        (2, 5, "assistant", long), (2, 6, "assistant", long), (None, 0, "user", "u"), (None, 1, "assistant", "a"),
        (3, 0, "assistant", "<|turn|>assistant<|text|>x<|end|>"),
    ]
    df = frame(rows, KIND).withColumns({c: F.lit("own") for c in ("row", "n", "ids", "mask", "position", "start", "bucket", "place")})
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(df)).collect()}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).digest())
    assert found == expected(sorted(rows, key=order))


def test_positions_and_starts_over_many_tasks(spark, frame, monkeypatch):
    """One conversation holds most rows; its places come from sums over buckets."""
    monkeypatch.setattr(chat, "_BUCKET_BITS", 3)
    rows = [(1, i, "user" if i % 2 else "assistant", "w " * (i % 13)) for i in range(300)] + [(c, 0, "user", "x") for c in range(2, 40)]
    found = sorted((r["conv_id"], r["position"], r["start"], len(r["ids"]) // 4) for r in chat.format_turns(frame(rows, KIND)).collect())
    at = {}
    for conv, position, start, n in found:
        count, total = at.get(conv, (0, 0))
        assert (position, start) == (count, total)
        at[conv] = (count + 1, total + n)
    assert at[1][0] == 300 and len(at) == 39


def test_empty_table(spark, frame):
    assert chat.read_back(chat.format_turns(frame([], KIND))).count() == 0


def test_reserved_ids_lie_beyond_the_vocabulary(encoder):
    assert encoder.tokenizer.get_vocab_size() <= min(chat.RESERVED.values())
    assert np.unique(list(chat.RESERVED.values())).size == len(chat.RESERVED)


def test_blocks_of_a_conversation_over_many_tasks(spark, frame, monkeypatch):
    """Whatever the size of blocks and buckets, the digests are those of the turns in order."""
    monkeypatch.setattr(chat, "_BUCKET_BITS", 4)
    monkeypatch.setattr(chat, "BLOCK", 200)
    rows = [(None if i < 50 else 7, i, "user" if i % 3 else "assistant", f"é{i} " * (i % 11)) for i in range(700)]
    rows += [(c, 0, "assistant", "x" * c) for c in range(40)]
    formatted = chat.format_turns(frame(rows, KIND).repartition(5))
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    held = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        held.setdefault(row[0], []).append(row)
    assert found == expected([r for part in held.values() for r in part])


def test_turns_join_only_their_neighbours():
    import pyarrow as pa

    turn = ("user", "a", "", 5)
    columns = chat._joined(pa.array([1, 1, 2, 2, None, None]), [0, 1, 0, 2, 0, 1], [turn] * 6)
    assert columns[0].to_pylist() == [1, 2, 2, None]
    assert list(columns[1]) == [0, 0, 2, 0] and list(columns[2]) == [2, 1, 1, 2]
    assert columns[3][0] == b"user\na\n" * 2
