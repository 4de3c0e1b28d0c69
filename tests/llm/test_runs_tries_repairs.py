"""Line runs, the prefix trie and structure repair against plain versions, on hard rows and in small blocks."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import line_dedup, prefix_trie, structure_repair
from tallyfield.llm.queries import QUERIES, damaged
from tallyfield.llm.turns import hashed, in_order

SPACE = " \t\n\x0b\f\r"
DOCS = "doc_id long, text string, lang string, n_lines string, row long, drops string, batch int, hi long"
CONVS = "conv_id long, turn long, role string, text string, pos long, share long, key string, letter string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain_lines(texts, least):
    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for lines in split for k in {lower(x) for x in lines})
    kept = [[x for x in lines if not lower(x) or held[lower(x)] < least] for lines in split]
    return [("\n".join(k), len(lines), len(lines) - len(k)) for lines, k in zip(split, kept, strict=True)]


@pytest.fixture(scope="module")
def line_docs():
    rng = random.Random(5)
    texts = [None, "", "\n", " \t\n\x0b ", "Ünder É\nünder É", "a" * 200_000 + "\nSHARED one", "shared ONE \n" * 5000 + "end"]
    for i in range(90):
        lines = [f"own {i} {rng.random()}", rng.choice(["Shared one", "\x0bshared ONE\r", "shared two"]), rng.choice(["", "shared three", f"pair {i // 2}"])]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    return texts + ["Shared one\nshared three"] * 40  # a third of all rows are copies


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_lines_match_a_plain_count(spark, line_docs, batches):
    rows = [(None if i % 7 == 0 else i // 2, t, "x", "y", i, "z", i, i) for i, t in enumerate(line_docs)]
    docs = spark.createDataFrame(rows, DOCS)
    got = line_dedup.dedup_lines(docs, least=10, batches=batches)
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    want = plain_lines(line_docs, 10)
    told = {r["row"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got.select("row", "text", "n_lines", "n_dropped").collect()}
    assert [told[i] for i in range(len(rows))] == want


def test_no_documents_no_lines(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_leave_out_what_is_known_and_merge(spark):
    index = line_dedup.LineRuns(spark, least=2, buckets=3)
    batch = lambda keys: spark.createDataFrame([(i, 0, k, k, True) for i, k in enumerate(keys)], "row long, pos int, hi long, lo long, first boolean")
    index.add(batch([1, 1, 2]))
    index.add(batch([1, 3]))  # 1 is known: only 3 is new
    assert [len(x) for x in index.levels] == [0, 1] and spark.table(index.runs()[0]).count() == 3
    index.add(batch([2, 4, 1]))
    assert [len(x) for x in index.levels] == [1, 1] and {r["hi"] for r in spark.table(index.runs()[0]).collect()} == {2, 4}
    folders = [f"{index._home}/{n}".removeprefix("file:") for n in index.runs()]
    assert all(map(os.path.isdir, folders))
    assert {r["hi"] for r in index.frequent().collect()} == {1, 2}
    index.close()
    assert not any(map(os.path.isdir, folders)) and index.frequent().count() == 0


def test_runs_are_merged_without_a_shuffle(spark, capsys):
    index = line_dedup.LineRuns(spark, least=2, buckets=3)
    rows = spark.createDataFrame([(1, 1, 1)], "hi long, lo long, n long")
    a, b = index._write(rows), index._write(rows)
    spark.table(a).join(spark.table(b).hint("merge"), ["hi", "lo"], "full").explain()
    assert "Exchange" not in capsys.readouterr().out
    index.levels = [[a, b]]
    index.close()


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(convs.get(base, [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    kids = Counter(p[:-1] for p in members if p)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], sum(not kids[q] for q in below[p]), sum((len(members[q]) - 1) * words[q] for q in below[p]), sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("width", [2, 8])
def test_trie_matches_a_plain_one(spark, monkeypatch, width):
    rng = random.Random(width)
    rows = [(None, 1, "user", "lost"), (20, None, None, None), (20, None, "user", "x y"), (20, 3000, "user", "far"), (21, 0, "a", "b"), (-3, 0, "user", "hi"), (-20, 1, "user", "hi there"), (0, 5, "", "")]
    for c in range(40, 90):  # some have fewer turns than they borrow, where the family's first has none
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no I do", ""])) for t in range(rng.choice([1, 1, 2, 3, 7]))]
    for c in range(200, 230):  # a third are copies
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    rows += [(301, t, "user", "long " * 20000) for t in range(40)] + [(60, 1, "user", "again")] * 2
    table = spark.createDataFrame([(*r, 1, 2, "k", "l") for r in rows], CONVS)
    blocks, rolled = prefix_trie.blocks, prefix_trie.rolled
    monkeypatch.setattr(prefix_trie, "blocks", lambda t, c: blocks(t, c, width))
    monkeypatch.setattr(prefix_trie, "rolled", lambda w, **sums: rolled(w, width, **sums))
    got = prefix_trie.prefix_trie(table)
    told = sorted(tuple(-1 if v is None else v for v in r) for r in got.select(*NODE).collect())
    assert told == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a", 1, 2, "k", "l")], CONVS)).count() == 0


def cheapest(rows):
    """All edits of (role initial, must go, truncated), any number of insertions: least (cost, audit)."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        if (at, last) in seen:
            continue
        seen.add((at, last))
        for (a, b), to in steps.items():
            if a == last and b != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", at, to))
            if a == last and at < len(rows) and not rows[at][1]:
                if rows[at][0] == b:
                    heapq.heappush(heap, (cost + rows[at][2], audit + "K", at + 1, to))
                if b != "s":
                    heapq.heappush(heap, (cost + 2 + rows[at][2], audit + "R", at + 1, to))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last))
    return None


def test_plan_is_the_cheapest_and_first():
    rng = random.Random(3)
    for n in range(400):
        rows = [(rng.choice("sssuuuaaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(12))]
        letters = "".join(structure_repair.LETTERS[structure_repair.ROLES.index(r) + (8 if gone else 4 if short else 0)] for r, gone, short in rows)
        size = rng.choice([1, 2, 3, 100])
        cost, audit, edits = structure_repair.repair_plan([letters[i : i + size] for i in range(0, len(letters), size)])
        assert (cost, audit) == cheapest([(r, gone, short and not gone) for r, gone, short in rows]), (n, letters, size)
        assert [e for _, e, _ in edits] == list(audit) and [r for r, _, _ in edits if r is not None] == list(range(len(rows)))


def plain_repair(rows, convs):
    """The contract read line by line, for rows after damage."""
    out = []
    for c in convs:
        own = [(t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), t, r, x) for cc, t, r, x in rows if cc == c]
        own = [r[3:] for r in sorted(own)]
        faults, seen = [], set()
        for _, r, x in own:
            end = x.strip(SPACE)[-1:]
            faults.append("b" if not end else "d" if (r, x) in seen else "t" if end not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest([(i, f in ("b", "d"), f == "t") for i, f in zip(initials, faults, strict=True)])
        lines, at, last = [], 0, ""
        for e in audit:
            new = "assistant" if last == "u" else "user"
            if e in "KR":
                lines.append(f"{own[at][1] if e == 'K' else new}:{own[at][2]}")
            elif e == "I":
                lines.append(f"{new}:")
            if e != "D":
                last = lines[-1][0]
            at += e != "I"
        out.append((c, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def test_query_matches_the_contract_on_hard_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 1, "user", "x."), (5, None, "tool", "y!"), (5, None, None, " \t"), (6, 0, "", ""), (7, 3, "assistant", "no end"), (7, 90, "assistant", "no end")]
    for c in range(10, 60):
        rows += [(c, rng.choice([t, t, t, 0, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "xy", None]), rng.choice(["Yes.", "No!", "maybe", "", f"{t} is it?", None])) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, rng.choice(["user", "assistant"]), f"{rng.randrange(50)} words" + rng.choice(["", "."])) for t in range(700)]  # several segments
    spark.createDataFrame([(*r, 1, 2, "k", "l") for r in rows], CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_structure_repair"](spark, str(tmp_path))
    cols = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    after = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()]
    want = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if fault == 4 else r, "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x)
        want += [row] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(repr, after)) == sorted(map(repr, want))
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == plain_repair(want, {r[0] for r in rows})


def test_repair_of_nothing(spark, tmp_path):
    report, turns = structure_repair.repair(spark.createDataFrame([], CONVS))
    assert report.count() == 0 and turns.count() == 0
    spark.createDataFrame([], CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_structure_repair"](spark, str(tmp_path)).count() == 0


def test_places_and_hashes_of_very_long_groups(spark):
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") * 7 % 5000 - 2500).alias("turn"), F.lit("k").alias("key"))
    assert in_order(rows, "key").where("pos <> turn + 2501").count() == 0
    parts = spark.range(30_000).select((F.col("id") % 3 == 0).alias("k"), "id", F.col("id").cast("string").alias("p"))
    got = {r["k"]: r["digest"] for r in hashed(parts, ["k"], ["id"], "p", "-").collect()}
    assert got == {k: sha("-".join(str(i) for i in range(30_000) if (i % 3 == 0) == k)) for k in (True, False)}


def test_stages_pass_columns_of_any_name(spark, tmp_path):
    """Columns named like the stages' own come out as they went in; a very long text, ties and nulls among the rows."""
    import corpus_pipeline

    own = ["seqs", "cut", "__row", "__copies", "__copy", "__doc", "row", "component_id", "predicted", "size", "of"]
    text = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, text(60, "a"), "en", "s", 5), (2, text(60, "a"), None, "s", 5), (2, text(300, "b"), "en", None, 5), (None, None, "en", "s", 5), (3, "", "en", "t", 5), (4, text(100_000, "long"), "en", "t", 5), (5, text(80, "c") + " " + text(60, "a"), "en", "t", 5)]
    table = spark.createDataFrame([(*r, *[f"{n}{i}" for n in own]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in own))
    table.coalesce(1).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    want = {tuple(f"{n}{i}" for n in own) for i in range(len(rows))}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns, name
        told = [tuple(r) for r in got.select(*own).collect()]
        assert set(told) <= want, name
        if name == "substrings":
            assert sorted(told) == sorted(want)
        if name == "near_duplicates":
            assert len(told) == len(rows) - 1  # one of the two equal texts
        if name == "mixing":
            assert told
    assert corpus_pipeline.packing(spark, docs, "").where("length > 0").count() >= len(rows)
