"""What is compared of a wide group of near copies grows with the group, not with its square, and no link is lost."""

import random

from tests.llm.brute import brute_components
from termdrift.llm import near_dedup


def wide_group(copies, seed=3):
    """Copies of one text, each with some words of its own, so that far ones are near to some of the others only."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    text = {}
    for i in range(copies):
        words = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 2, 3, 3, 4))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        text[i] = " ".join(words)
    return text


def test_far_copies_meet_some_of_a_group_before_all_of_it(spark, monkeypatch):
    text, compared, confirmed = wide_group(500), [], near_dedup.confirmed

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    got = near_dedup.cluster_documents(spark.createDataFrame(list(text.items()), "doc_id long, text string"), shingle=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(text, 4)[1]
    assert compared[-1] < 4 * len(text)
