"""The fences of the quality rules against plain sorted lists."""

import random
from collections import defaultdict

from curalake.llm import quality


def leading(value):
    return value if value < 64 else value - value % (1 << (value.bit_length() - 6))


def values_of(counts):
    n, chars, symbols, copies, repeats, lines = counts
    return {
        "symbols": symbols * 1000 // max(chars, 1), "word_length": chars * 100 // max(n, 1), "dup_lines": copies * 1000 // max(lines, 1),
        "repeats": repeats * 1000 // max(n, 1),
    }


def quantile(values, pct):
    ordered = sorted(values)
    return ordered[max(-(-len(ordered) * pct // 100), 1) - 1]


def fence(values, outwards, least):
    sign = 1 if outwards[0] > 50 else -1
    median = quantile(values, 50)
    beyond = lambda at: at + sign * max(quality.SPREADS * abs(at - median), least, at // 32 + 1)
    at = quantile(values, outwards[0])
    for pct in outwards[1:]:
        further = quantile(values, pct)
        if sign * (further - beyond(at)) <= 0:
            at = further
    return beyond(at)


def verdicts(rows):
    """doc_id -> kept, from rows (doc_id, text, lang, source)."""
    counted = {i: (quality.text_measures(t), lang, source) for i, t, lang, source in rows}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, (c, _, _) in counted.items()}
    groups = [defaultdict(list) for _ in range(3)]
    for i, (c, lang, source) in counted.items():
        if not failed[i]:
            for group, key in zip(groups, ((lang, source), lang, None), strict=True):
                group[key].append({k: leading(v) for k, v in values_of(c).items()})
    out = {}
    for i, (c, lang, source) in counted.items():
        own = groups[0][lang, source], groups[1][lang], groups[2][None]
        sketch = next((g for g in own[:2] if len(g) >= quality.MIN_GROUP), own[2])
        ok = not failed[i]
        for k, v in values_of(c).items() if ok else ():
            _, _, _, sides, least, event = quality.MEASURES[k]
            seen = [g[k] for g in sketch]
            if sides == "both":
                ok = ok and fence(seen, quality.LOWER, least) <= v <= fence(seen, quality.UPPER, least)
            else:
                top = {"symbols": c[2], "dup_lines": c[3], "repeats": c[4]}[k]
                ok = ok and (v <= fence(seen, quality.UPPER, least) or top <= event)
        out[i] = ok
    return out


def test_fences_equal_sorted_quantiles(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        lang, source = rng.choice([("en", "hot")] * 6 + [("en", "b"), ("de", "hot"), ("de", None), (None, "b")])
        words = ["".join(rng.choice("abcdefgh") for _ in range(max(1, int(rng.gauss(5 if lang == "en" else 8, 1.5))))) for _ in range(rng.randint(20, 160))]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        if rng.random() < 0.4:
            lines += [rng.choice(lines) for _ in range(rng.choice([1, 1, 2, 6]))]
        text = "\n".join(lines)
        if rng.random() < (0.9 if source == "b" else 0.1):
            text += " " + "#$%" * rng.randint(1, 40)
        rows.append((i, text, lang, source))
    rows += [(2000, None, "en", "hot"), (2001, "", None, None), (2002, "x " * 80, "en", "hot")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)
    found = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs).collect()}
    wanted = verdicts(rows)
    assert found == wanted
    assert 20 < sum(not v for v in wanted.values()) < 1200
