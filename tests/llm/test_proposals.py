"""Proposals of personal data leave a task in small pieces, however crowded a text is."""

import pandas as pd

from lineweave.llm import pii


def test_pieces_are_bounded_and_repeats_are_not_made_again():
    own = [f"call +1 (555) {n // 10000:03d}-{n % 10000:04d} now, " for n in range(0, 60_000, 10)]
    crowded = pd.DataFrame({"text": ["".join(own), None, "", *["mail bob at example dot com"] * 500]})
    pieces = list(pii._proposed(iter([crowded, crowded])))
    rows = pd.concat(pieces)
    most = max(len(p) for p in pieces)
    assert most < pii.PROPOSALS_AT_ONCE + len(list(pii.proposals(crowded["text"][0]))) and len(pieces) > 1
    assert all(p["h"].is_unique for p in pieces)
    alone = pd.concat(pii._proposed(iter([crowded[:1]])))
    assert set(alone["h"]) <= set(rows["h"])


def test_many_short_texts_are_cut_into_pieces():
    texts = pd.DataFrame({"text": [f"card 4111 1111 1111 {n:04d} and tel 555 {n:03d} {n:04d}" for n in range(9_000)]})
    pieces = list(pii._proposed(iter([texts])))
    assert len(pieces) > 1 and max(len(p) for p in pieces) < pii.PROPOSALS_AT_ONCE + 10
