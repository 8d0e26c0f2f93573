"""Commits that race, ids that repeat with other texts, items without a name, Python run once per row."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest

from kohorta.llm import ngram_join, queries as Q
from kohorta.llm.decontamination import contamination, decontaminate, item_blocks
from kohorta.llm.line_dedup import drop_repeated_lines
from kohorta.llm.ngram_join import ngram_components, one_per_component
from kohorta.llm.token_counts import TokenLedger, count_changes, inserts, word_counter
from kohorta.session import run_dir
from tests.llm.test_edges import _words
from tests.llm.test_operators import SF, tables
from tests.llm import brute

ROW = "doc_id bigint, text string, source string, lang string"


def _sums(spark, text):
    return count_changes(inserts(spark.createDataFrame([(1, text, "s", "en")], ROW)), {"words": word_counter})


def test_of_two_writers_of_a_batch_one_commits(spark, monkeypatch):
    ledger = TokenLedger(spark, f"{run_dir(spark)}/ledger-race")
    first, second = _sums(spark, "a b c"), _sums(spark, "a b c")
    name = None
    real = TokenLedger._claim

    def interleaved(self, batch_name, attempt):
        """The second writer does all its work between the first one's attempt and its claim."""
        nonlocal name
        if name is None:
            name = batch_name
            assert self.commit("batch", second)
        return real(self, batch_name, attempt)

    monkeypatch.setattr(TokenLedger, "_claim", interleaved)
    assert not ledger.commit("batch", first)
    assert [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()] == [(1, 3)]
    monkeypatch.setattr(TokenLedger, "_claimed", lambda self, name: False)
    assert not ledger.commit("batch", first)
    assert [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()] == [(1, 3)]


def test_a_writer_that_dies_before_its_claim_leaves_nothing(spark, monkeypatch):
    ledger = TokenLedger(spark, f"{run_dir(spark)}/ledger-dead")

    def die(self, name, attempt):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(TokenLedger, "_claim", die)
        with pytest.raises(RuntimeError):
            ledger.commit("one", _sums(spark, "a b"))
    assert ledger.totals().count() == 0
    assert ledger.commit("other", _sums(spark, "a b c d")) and ledger.commit("one", _sums(spark, "a b"))
    assert [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()] == [(2, 6)]


@tables
def test_token_totals_are_those_of_the_documents_that_are_left(spark):
    want = {}
    for r in Q.table(spark, SF, "documents").collect():
        lines = (r.text or "").split("\n")
        text = "\n".join(x for i, x in enumerate(lines) if not i or x != lines[i - 1])
        if len(text) >= Q.SHORT_CHARS:
            own = want.setdefault((r.source, r.lang), [0, 0, 0])
            for k, v in enumerate((1, len(brute.BLANKS.findall(text)), len(text))):
                own[k] += v
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in Q.op3_token_counts(spark, SF).where("tokenizer = 'words/1'").collect()}
    assert got == want


def test_equal_ids_with_other_texts_keep_every_text(spark):
    a, b, c = _words(1, 40), _words(2, 40), _words(3, 40)
    rows = [(2, b), (4, a), (4, b), (4, a), (5, c), (5, c + " end"), (6, c), (None, a), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in one_per_component(docs).collect()), key=str)
    near_five = [x for x in kept if x[0] == 5]
    assert len(near_five) == 1 and near_five[0][1] in (c, c + " end")
    assert sorted((x for x in kept if x[0] != 5), key=str) == sorted([(2, b), (4, a), (None, a), (7, "")], key=str)


def test_items_without_a_name_are_matched(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "two three"), (5, "three")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, items).collect()}
    assert got == {1: (2, 1, brute.sha(b"5"), True), 2: (0, 0, brute.sha(b""), False)}
    assert [r.doc_id for r in decontaminate(docs, items).collect()] == [2]


@pytest.mark.parametrize("stage", ["lines", "items"])
def test_a_text_is_handled_once(spark, stage):
    docs = spark.createDataFrame([(1, "one two\nthree")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "two three")], "item_id bigint, text string")
    out = drop_repeated_lines(docs) if stage == "lines" else decontaminate(docs, items)
    with redirect_stdout(io.StringIO()) as plan:
        out.explain("simple")
    assert plan.getvalue().count("ArrowEvalPython") == 1


def test_benchmark_of_many_blocks(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]

    def draw(n):
        return [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]

    named = [(i, " ".join(draw(n))) for i, n in enumerate([300, 200, 120, 60, 40, 13, 12, 3, 0])]
    items = [*named, (20, named[0][1]), (3, named[3][1]), (None, " ".join(draw(30)))]
    rows = [(1, None), (2, ""), (None, named[1][1])]
    for i in range(40):
        words = draw(int(rng.integers(0, 120)))
        source = items[int(rng.integers(0, len(items)))][1].split()
        at = int(rng.integers(0, max(len(source) - 30, 1)))
        rows.append((10 + i, " ".join(words[:50] + source[at : at + int(rng.integers(10, 70))] + words[50:])))
    rows += [rows[5], rows[5], (7, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    pieces, blocks = item_blocks(benchmark, 200)
    assert blocks > 3 and pieces.select("block").distinct().count() > 3

    def found(**options):
        return sorted(map(tuple, contamination(docs, benchmark, **options).collect()), key=str)

    assert found(block_words=200) == found()
    without_name = [r[:2] for r in items if r[0] is not None]
    unhit = {" ".join(r[1].split()) for r in items if r[0] is None}
    want = [(d, *brute.contamination(t, without_name)) for d, t in rows]
    exact = [w for w, (_, t) in zip(want, rows) if not any(_shares(t, u) for u in unhit)]
    assert len(exact) > 30 and set(exact) <= set(found())
    cut = [sorted(map(tuple, decontaminate(docs, benchmark, **o).collect()), key=str) for o in ({}, {"block_words": 200})]
    assert cut[0] == cut[1] and 0 < len(cut[0]) < len(rows)


def _shares(text, item, size=13):
    have, want = (text or "").split(), item.split()
    windows = {tuple(want[i : i + size]) for i in range(len(want) - size + 1)}
    return any(tuple(have[i : i + size]) in windows for i in range(len(have)))


@pytest.fixture
def large_rooms(monkeypatch):
    """Sizes of the rooms of large families, with blocks of four sets."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    sizes, plain = [], ngram_join._large_rooms

    def counted(*args):
        rooms = plain(*args)
        sizes.append(rooms.count())
        return rooms

    monkeypatch.setattr(ngram_join, "_large_rooms", counted)
    return sizes


def test_pivots_contract_a_large_family(spark, large_rooms):
    """Near copies of one text that all link leave nothing to multiply."""
    base = [f"b{i}" for i in range(120)]
    near = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    docs = spark.createDataFrame(near, "doc_id bigint, text string")
    assert {r.component_id for r in ngram_components(docs).collect()} == {0}
    assert large_rooms == [0]


def test_components_that_pivots_leave_apart_are_multiplied(spark, large_rooms):
    """Windows that slide along a text link to the next few; at one gap they share columns and do not link."""
    words = [f"b{i}" for i in range(600)]
    begins = [5 * i + (60 if i >= 30 else 0) for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[b : b + 120])) for i, b in enumerate(begins)], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_components(docs).collect()} == {(i, 0 if i < 30 else 30) for i in range(60)}
    assert len(large_rooms) == 1 and large_rooms[0] > 0
