from collections import Counter, defaultdict

import corpus_pipeline as P
from gridledger.llm import common, langid, mixing, pieces
from tests.llm.helpers import AWKWARD, docs
from tests.llm.test_mixing import filled
from tests.llm.test_near_copies import staying


def test_stages_against_plain_versions(spark, sf_dir):
    d = common.docs_of(spark, sf_dir)
    docs_ = rows = {r.doc_id: r for r in d.collect()}
    stage = dict(P.STAGES)

    model = langid.train(d)
    d = common.settle(stage["language ID"](spark, d, sf_dir), "t")
    named = {i: model.predict(r.text) for i, r in rows.items()}
    rows = {i: (lambda x: type(r)(**x))(r.asDict() | {"lang": named[i][0]}) for i, r in rows.items() if named[i][0] != "und" and not named[i][2]}
    assert {r.doc_id: r for r in d.collect()} == rows
    assert all(not any(map(str.isalpha, t)) for t in (r.text for r in docs_.values() if named[r.doc_id][0] == "und"))

    d = common.settle(stage["exact dedup"](spark, d, sf_dir), "t")
    last = {r.text: i for i, r in sorted(rows.items())}
    rows = {i: r for i, r in rows.items() if last[r.text] == i}
    assert {r.doc_id: r for r in d.collect()} == rows

    d = common.settle(stage["SimHash near-dedup"](spark, d, sf_dir), "t")
    rows = {i: rows[i] for i in staying({i: r.text for i, r in rows.items()})}
    assert {r.doc_id: r for r in d.collect()} == rows

    d = common.settle(stage["mixing sources"](spark, d, sf_dir), "t")
    sizes, got, times = defaultdict(int), defaultdict(int), Counter()
    for r in rows.values():
        sizes[r.source] += len(r.text.split())
    for r in d.collect():
        assert r == rows[r.doc_id]
        times[r.doc_id] += 1
        got[r.source] += len(r.text.split())
    want = filled(sizes, (1, 2, 3))
    longest = defaultdict(int)
    for r in rows.values():
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    # whole documents: at most one of a source is taken in part
    assert max(times.values()) <= 3 and all(abs(got[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)

    out = stage["SentencePiece"](spark, d, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == times and all(r.lossless for r in out)
    model = pieces.pieces_of_model()
    for r in out:
        assert model.decode(r.ids).decode() == rows[r.doc_id].text and (r.source, r.lang) == (rows[r.doc_id].source, rows[r.doc_id].lang)


def test_the_mix_is_written_in_the_order_of_the_schedule(spark, sf_dir):
    d = common.docs_of(spark, sf_dir)
    first = {r.doc_id: r.first_slot for r in mixing.mix(d).collect()}
    seen, order = set(), []
    for r in mixing.repeat_documents(d).collect():  # partitions in their order
        if r.doc_id not in seen:
            seen.add(r.doc_id)
            order.append(first[r.doc_id])
    late = sum(b < a for a, b in zip(order, order[1:]))
    assert late <= len(order) / 10  # a document that begins in a block's last words may be taken from the next slot on


def test_clashing_columns(spark, sf_dir):
    """Columns with the names that stages use inside."""
    d = docs(spark, AWKWARD).selectExpr("*", "1 AS _gl_id", "2 AS _gl0", "'x' AS lang_pred", "3 AS slot", "4 AS times", "'y' AS ids", "'z' AS node", "5 AS _root", "6 AS ambiguous")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, sf_dir)
        assert out.columns == d.columns
        out.collect()
    assert P.STAGES[-1][1](spark, d, sf_dir).count() == len(AWKWARD)


def test_stages_on_awkward_and_empty_tables(spark, sf_dir):
    for rows in (AWKWARD, []):
        d = docs(spark, rows)
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, d, sf_dir)
            assert out.columns == d.columns and out.count() <= 3 * len(rows)
        assert P.STAGES[-1][1](spark, d, sf_dir).count() == len(rows)
