"""A small corpus and brute force that several tests share."""

import random

from termdrift.llm import near_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus_rows():
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (6, "mail jo.hn@site.org, +49 (30) 1234567 and 10.0.0.256 or 10.0.0.25"), (7, "4111 1111 1111 1111 and 4111 1111 1111 1112")]
    base = some(120)
    rows += [(20 + i, base) for i in range(6)]
    for i in range(24):
        w = base.split()
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((40 + i, " ".join(w)))
    rows += [(100 + i, "\n".join(some(6) if j % 3 else "A shared line of Text  " for j in range(7))) for i in range(16)]
    rows += [(200, "word " * 20000), (201, "y" * 50000), (202, "é́ 中文 \U0001f600\x1c\x85 xİ"), (203, "the  end\n\n\n")]
    rows += [(300 + i, some(40) + (" rude nasty" * (i % 4)) if i % 3 else " ".join(w + "%%%" for w in some(40).split())) for i in range(160)]
    return rows


def brute_components(text, size):
    sets = {}
    for i, t in text.items():
        w = near_dedup.WORDS(t.translate(near_dedup.FOLD))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    of = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(of)
        for a, b in linked:
            of[a] = of[b] = min(of[a], of[b])
        if before == of:
            break
    return sets, of
