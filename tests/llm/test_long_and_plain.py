"""Substring dedup against plain windows of words; very long texts through the text operators."""

import re

import pytest

from tallyfield.llm import mixing, spotsigs
from tallyfield.llm.line_dedup import dedup_lines
from tallyfield.llm.ngram_join import jaccard_components
from tallyfield.llm.quality_rules import quality_rules
from tallyfield.llm.substring_dedup import LEAST, dedup_substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def later_words(texts: dict[int, bytes]) -> dict[int, list[bool]]:
    """Of each text its words: whether one lies in a window of LEAST words that is found before, by (doc_id, place)."""
    seen, out = set(), {}
    for doc in sorted(texts):
        words = WORD.findall(texts[doc])
        mine = [False] * len(words)
        for i in range(len(words) - LEAST + 1):
            window = tuple(words[i : i + LEAST])
            if window in seen:
                mine[i : i + LEAST] = [True] * LEAST
            seen.add(window)
        out[doc] = mine
    return out


def test_cuts_lie_in_repeated_windows_and_cover_most_of_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    later = later_words(texts)
    repeated = cut_words = spans = 0
    for r in dedup_substrings(docs).collect():
        raw, cut = texts[r["doc_id"]], [(s["start"], s["end"]) for s in r["cut"]]
        at, keep = 0, []
        for a, b in cut:
            assert at <= a < b <= len(raw)
            keep.append(raw[at:a])
            at = b
        left = b"".join([*keep, raw[at:]])
        assert (r["text"] or "").encode() == (left.rstrip() if cut else left)
        starts = [m.start() for m in WORD.finditer(raw)]
        mine = [any(a <= s < b for a, b in cut) for s in starts] if cut else [False] * len(starts)
        # nothing is cut that plain windows don't find
        assert not any(c and not known for c, known in zip(mine, later[r["doc_id"]], strict=True))
        repeated += sum(later[r["doc_id"]])
        cut_words += sum(mine)
        spans += len(cut)
    assert spans and repeated and cut_words / repeated > 0.8, (cut_words, repeated)


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two texts of 300,000 words that differ in one, a short one, an empty one and a null."""
    words = [f"w{i * 2654435761 % 9973}" if i % 9 else "the" for i in range(300_000)]
    other = [*words[:149_995], "another", *words[149_996:]]  # right after a common word
    lines = lambda w: "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
    rows = [(1, lines(words), "en", "a"), (2, lines(other), "en", "a"), (3, "a few words", "en", "a"), (4, "", None, None), (5, None, "en", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


def test_long_texts_are_linked_whole(long_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(long_docs, k=3, percent=90).collect()}
    texts = {r["doc_id"]: r["text"] for r in long_docs.collect()}
    for doc, text in texts.items():
        w = (text or "").split()
        assert got[doc][0] == (len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else 0)
    assert [got[d][1] for d in range(1, 6)] == [1, 1, 3, 4, 5]


def test_long_texts_have_fingerprints_of_their_end_too(long_docs):
    got = {r["doc_id"]: r for r in spotsigs.neighbour_fingerprints(long_docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in long_docs.collect()}
    assert all(got[d]["n_chars"] == len(t) for d, t in texts.items())
    assert 0.999 < got[2]["near_next"] < 1.0  # one word of 300,000
    assert got[1]["fingerprint"] != got[2]["fingerprint"]


def test_long_texts_are_mixed_counted_and_cut_whole(long_docs):
    sizes = long_docs.select("doc_id", "source", mixing.words(long_docs["text"]).alias("size"))
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_sources(sizes).collect()}
    assert taken[1][0] == 300_000 and all(t <= 3 * s for s, t in taken.values())

    counts = {r["doc_id"]: r for r in quality_rules(long_docs).collect()}
    assert [counts[d]["n_words"] for d in range(1, 6)] == [300_000, 300_000, 3, 0, 0]

    left = {r["doc_id"]: r for r in dedup_substrings(long_docs.select("doc_id", "text")).collect()}
    assert not left[1]["cut"] or left[1]["text"]
    # all of the second but the surroundings of its own word is in the first
    assert len((left[2]["text"] or "").split()) < 200 and "another" in left[2]["text"]
    assert left[5]["text"] is None

    lines = {r["doc_id"]: r for r in dedup_lines(long_docs.select("doc_id", "text")).collect()}
    assert lines[1]["n_lines"] == 25_000 and lines[2]["n_dropped"] == 0 and "another" in lines[2]["text"]  # in fewer than ten documents
