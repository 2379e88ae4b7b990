import json
import os
import random
import re
import subprocess
import sys
from collections import defaultdict

import llm_fixtures as fx
import pytest

from brisktill.llm import linededup
from brisktill.llm.queries import QUERIES


def words_of(line):
    """Words with digits are wild unless they are most of the line; written from the words, not from the operator's keys."""
    words = re.findall(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]|[^\s\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+", line)
    wild = ["*" if re.search(r"\d", w) else w for w in words]
    return tuple(wild if 2 * sum(bool(re.search(r"\d", w)) for w in words) <= len(words) else words)


def agree(a, b):
    """Whether two tails of one length agree on half of their (at most eight) pieces, and on two at least."""
    n = min(len(a), 8)
    pieces = [(len(a) * i // n, len(a) * (i + 1) // n) for i in range(n)]
    same = sum(a[x:y] == b[x:y] for x, y in pieces)
    return 2 * same >= n and same >= 2


def brute(docs):
    """[(id, text)] to [(id, lines dropped, rest)] by walking all lines; a null id is a document, the last one."""
    rank = lambda i: (i is None, i or 0)
    rows = [(n, k, rank(i), found) for n, (i, t) in enumerate(docs) for k, line in enumerate((t or "").split("\n")) if (found := words_of(line))]
    whole, leaves, holders = {}, defaultdict(set), defaultdict(set)
    for n, k, doc, words in rows:
        if len(words) < 5:
            holders[words].add(doc)
            continue
        whole[words] = min(whole.get(words, doc), doc)
        leaves[len(words), words[:8]].add((doc, words[8:]))
    drop = defaultdict(set)
    for n, k, doc, words in rows:
        if len(words) < 5:
            if len(holders[words]) >= 10 and min(holders[words]) < doc:
                drop[n].add(k)
            continue
        if whole[words] < doc or any(first < doc and agree(words[8:], tail) for first, tail in leaves[len(words), words[:8]]):
            drop[n].add(k)
    return [(i, len(drop[n]), t if not drop[n] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[n])) for n, (i, t) in enumerate(docs)]


def test_query_equals_brute_force(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in QUERIES["op7_line_dedup"](spark, folder).collect())
    assert found == sorted(brute(docs)) and any(n for _, n, _ in found)


def leafy(n, rng):
    """Lines of a few leaves whose tails share some words with one another, of every tail length up to ten."""
    rows = []
    for i in range(n):
        lines = []
        for _ in range(2):
            length = rng.randint(0, 10)
            lines.append(" ".join(["one opening that all the lines here have", *(rng.choice("abcdefg") * 2 for _ in range(length))]))
        rows.append((None if i % 50 == 7 else rng.randint(0, n // 2), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("at_once", [0, 3, 1000])
def test_lines_meet_every_earlier_line_of_their_leaf(spark, frame, monkeypatch, at_once):
    monkeypatch.setattr(linededup, "TAILS_AT_ONCE", at_once)
    docs = leafy(150, random.Random(4))
    found = [(r["doc_id"], r["n_dropped"], r["text"]) for r in linededup.dedup(frame(docs, "doc_id long, text string")).collect()]
    wanted = brute(docs)
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and 30 < sum(n for _, n, _ in wanted) < 250


def near_copies(n, rng):
    """One line per document, each with up to ten words of its own after an opening that all share."""
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(88)]
    rows = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice([2, 4, 6, 10])):
            words[rng.randrange(8, 88)] = "x" + "".join(rng.choice("abcdefgh") for _ in range(6))
        rows.append((None if rng.random() < 0.02 else rng.randrange(n), " ".join(words)))
    return rows


def test_near_copies_of_one_line_equal_brute_force(spark, frame):
    docs = near_copies(500, random.Random(6))
    found = [(r["doc_id"], r["n_dropped"], r["text"]) for r in linededup.dedup(frame(docs, "doc_id long, text string")).collect()]
    wanted = brute(docs)
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and 200 < sum(n for _, n, _ in wanted) < 480


COUNTED = """
import json, sys
from brisktill.llm import linededup
from brisktill.session import build_session
folder = sys.argv[1]
spark = build_session("rows", "local[4]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__eventLog__enabled="true",
                      spark__eventLog__dir=folder + "/log", spark__eventLog__compress="false", spark__eventLog__rolling__enabled="false")
docs = spark.createDataFrame(json.load(open(folder + "/docs.json")), "doc_id long, text string")
linededup.dedup(docs).collect()
spark.stop()
"""


def test_near_copies_of_one_line_make_few_rows(tmp_path):
    """Rows made by exploding keys, from Spark's event log: 140 a tail if each is taken by every sufficient set, twice."""
    n = 600
    (tmp_path / "log").mkdir()
    (tmp_path / "docs.json").write_text(json.dumps(near_copies(n, random.Random(6))))
    root = os.path.dirname(os.path.dirname(linededup.__file__))
    env = {**os.environ, "PYTHONPATH": os.path.dirname(root)}
    subprocess.run([sys.executable, "-c", COUNTED, str(tmp_path)], check=True, env=env, timeout=300)
    events = [json.loads(line) for file in (tmp_path / "log").iterdir() if file.is_file() for line in file.open()]
    counters = set()

    def walk(node):
        if "Generate" in node["nodeName"]:
            counters.update(m["accumulatorId"] for m in node["metrics"] if m["name"] == "number of output rows")
        for child in node["children"]:
            walk(child)

    for e in events:
        if "sparkPlanInfo" in e:
            walk(e["sparkPlanInfo"])
    ended = [a for e in events if e["Event"] == "SparkListenerTaskEnd" for a in e["Task Info"]["Accumulables"]]
    assert 0 < sum(int(a["Update"]) for a in ended if a["ID"] in counters) < 80 * n


def test_later_templates_of_a_leaf_count(spark, frame):
    """Two families of lines begin alike; the second one's recurrence goes too."""
    head = "please note that all of these opening hours"
    families = ["are valid from monday to friday in the shop of {}", "may change without notice when {} keeps a public holiday here"]
    docs = [(i, head + " " + families[i % 2].format(name)) for i, name in enumerate(["Berlin", "London", "Paris", "Rome"])]
    found = {r["doc_id"]: r["text"] for r in linededup.dedup(frame(docs, "doc_id long, text string")).collect()}
    assert found == {0: docs[0][1], 1: docs[1][1], 2: "", 3: ""}


def test_awkward_rows(spark):
    docs = fx.clashing(fx.awkward(spark))
    found = linededup.dedup(docs, count_col="dropped_here")
    assert found.columns == [*docs.columns, "dropped_here"]
    got = [(r["doc_id"], r["dropped_here"], r["text"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(brute([r[:2] for r in fx.awkward_rows()]), key=repr)


def test_variable_fields_are_generalised(spark, frame):
    head = "This work is licensed under the terms of version"
    docs = [
        (1, f"{head} 1 of the licence by Ann Miller of Berlin and may be copied by all who like it\nown line of the first document"),
        (2, f"{head} 2 of the licence by Bob Smith of London and may be copied by all who like it\nown line of the second document"),
        (3, f"{head} 3 entirely different words that only begin as the others do and then go on quite alone here\nThird one."),
    ]
    found = {r["doc_id"]: r["text"].split("\n") for r in linededup.dedup(frame(docs, "doc_id long, text string")).collect()}
    assert len(found[1]) == 2 and found[2] == ["own line of the second document"] and len(found[3]) == 2


def test_short_lines_and_own_repeats_stay(spark, frame):
    docs = [(1, "Yes.\nAnd so it went on and on.\nAnd so it went on and on."), (2, "Yes.\nOther words are said in here."), (2, "Other words are said in here.")]
    found = linededup.dedup(frame(docs, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in found.collect()) == sorted((i, t, 0) for i, t in docs)


def test_passage_stays_in_one_document_only(spark, frame):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = [(i, f"{fx.prose(i, 80)}\n{passage}\n{fx.prose(100 + i, 30)}") for i in range(40)]
    found = linededup.drop_lines(frame([(*d, len(d[1])) for d in docs], "doc_id long, text string, n_chars int")).collect()
    assert [r["doc_id"] for r in found if passage in r["text"]] == [0] and len(found) == 40
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_copies_lose_their_last_word_and_go(spark, frame):
    text = "\n".join(f"a line of some words number {chr(97 + i)} that repeats" for i in range(4))
    docs = frame([(1, text), (2, text), (3, None), (4, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in linededup.drop_lines(docs).collect()) == [(1, text), (3, None), (4, "")]


def test_empty_table(spark):
    assert linededup.dedup(fx.empty(spark)).count() == 0
    assert linededup.drop_lines(fx.empty(spark)).columns == fx.empty(spark).columns


def test_rows_keep_their_lines_when_the_table_is_split_anew(spark, tmp_path):
    shared = "this one line is in every document of the table"
    docs = [(i, f"{fx.prose(i, 40)}\n{shared}" if i % 3 else f"{shared}\n{fx.prose(i, 40)}") for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(7, "doc_id").write.parquet(f"{tmp_path}/t")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    found = linededup.dedup(spark.read.parquet(f"{tmp_path}/t"))
    try:
        spark.conf.set(size, "1k")
        left = {r["doc_id"]: r["text"] for r in found.collect()}
    finally:
        spark.conf.set(size, before)
    assert left == {i: t for i, _, t in brute(docs)}


def test_short_lines_of_many_documents_go(spark, frame):
    docs = [(i, f"{fx.prose(i, 30)}\nAll rights reserved.\n{'Chance.' if i < 2 else fx.prose(50 + i, 12)}") for i in range(12)]
    docs.append((None, f"All rights reserved.\n{fx.prose(99, 12)}"))
    found = {r["doc_id"]: r for r in linededup.dedup(frame(docs, "doc_id long, text string")).collect()}
    assert [i for i, r in found.items() if "All rights reserved." in r["text"]] == [0]
    assert "Chance." in found[1]["text"] and found[1]["n_dropped"] == 1


def test_lines_without_spaces_are_deduplicated(spark, frame):
    passage = "\u672c\u7ad9\u6240\u6709\u5185\u5bb9\u5747\u53d7\u7248\u6743\u4fdd\u62a4\uff0c\u672a\u7ecf\u8bb8\u53ef\u4e0d\u5f97\u8f6c\u8f7d\u3002"
    docs = [(1, f"{passage}\n\u5c71"), (2, f"{passage}\n\u5c71\u5ddd"), (3, "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\n\u5c71")]
    found = sorted((r["doc_id"], r["text"]) for r in linededup.dedup(frame(docs, "doc_id long, text string")).collect())
    assert found == [docs[0], (2, "\u5c71\u5ddd"), docs[2]]


def test_short_tails_that_differ_stay(spark, frame):
    head = "the following items are sold here every morning:"
    docs = [
        (1, f"{head} fresh green apples grapes"), (2, f"{head} spare truck tyres tubes"), (3, f"{head} fresh green apples tubes"),
        (4, f"{head} fresh"), (5, f"{head} spare"), (6, f"{head} ripe fresh"), (7, f"{head} ripe spare"), (8, f"{head} 5 ripe figs"), (9, f"{head} 7 ripe figs"),
    ]
    found = {r["doc_id"]: r["text"] for r in linededup.dedup(frame(docs, "doc_id long, text string")).collect()}
    assert sorted(i for i, t in found.items() if not t) == [3, 9]
    assert {i: t for i, _, t in brute(docs)} == found
