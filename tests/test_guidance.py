"""Guidance sentences, scopes of headings, disclaimers and zero-filled counts."""

import pytest

from tidemark.operators import guidance as g

RELEASE = (
    "ACME CORP REPORTS RESULTS\n\nACME today reported revenue of $5 million to $6 million.\n\nFinancial Outlook\n\nFor the fourth quarter, the Company expects net revenue in the range of $1.20 billion to $1.30 billion. Margins of 18% - 20%. "
    "It has no debt.\n\nWe now anticipate earnings of between $4.10 and $4.30.\n\nForward-Looking Statements\n\nSales of $2 to $3 were paid.\n\nThis has forward-looking statements, e.g. we expect $1 to $2; undue reliance is unwise.\n\n"
    "Revenue is expected to be $108.0 billion, plus or minus 2%.\n  \nLooking Ahead\n\n  Prices of $7 through $9."
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, RELEASE), (2, "Nothing here."), (3, None), (4, ""), (5, "Guidance\n\nA 5% to 6% rise. And no more.")], "doc_id long, text string")


def test_sentences_scopes_and_places(docs):
    rows = sorted(g.guidance(docs).collect(), key=lambda r: (r.doc_id, r.start))
    assert [(r.doc_id, r.anchor, r.section) for r in rows] == [(1, "company_expects", "outlook"), (1, "outlook", "outlook"), (1, "we_expect", "outlook"), (1, "expected_to_be", None), (1, "looking_ahead", "looking_ahead"), (5, "guidance_heading", "guidance_heading")]
    assert all(RELEASE[r.start : r.end] == r.sentence for r in rows if r.doc_id == 1) and rows[4].sentence == "Prices of $7 through $9."
    assert set(rows[0].hits) == {"dollar_range", "range_of", "company_expects", "for_period", "outlook"} and set(rows[3].hits) == {"tolerance", "expected_to_be"}


def test_counts_have_zeros(docs):
    counts = {(r.doc_id, r.anchor): r.n for r in g.anchor_counts(docs, g.guidance(docs)).collect()}
    assert len(counts) == 5 * len(g.ANCHORS) and sum(n for (d, _), n in counts.items() if d in (2, 3, 4)) == 0
    assert counts[1, "outlook"] == 3 and counts[1, "dollar_range"] == 2 and counts[1, "reaffirm_guidance"] == 0 and counts[5, "percent_range"] == 1
