"""Language ID against Kneser-Ney by dictionaries, on rows that the fit hasn't seen, and through the query."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import langid

O = langid.ORDER  # noqa: E741


def counted(texts):
    s, starts, _ = langid.symbols(texts)
    own = np.ones(len(s), bool)
    own[(starts[:, None] - np.arange(1, O)).ravel()] = False
    return np.unique(langid.grams(s)[own], return_counts=True)


def spelled(text):
    """Runs of what isn't a letter are one space; O - 1 spaces before."""
    return " " * (O - 1) + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).lstrip()


class Brute:
    """Interpolated Kneser-Ney, one n-gram at a time; order k < O counts distinct characters before an n-gram."""

    def __init__(self, texts):
        top = Counter(s[i - O + 1 : i + 1] for s in map(spelled, texts) for i in range(O - 1, len(s)))
        self.levels = [top]
        for _ in range(O - 1):
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.by = []
        for n in self.levels:
            n1, n2 = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
            d = min(max((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.05), 0.95)
            total, kinds = defaultdict(int), defaultdict(int)
            for g, v in n.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            self.by.append((n, d, total, kinds))

    def p(self, gram, at=0):
        if at == O:
            return 1 / langid.VOCABULARY
        n, d, total, kinds = self.by[at]
        below = self.p(gram[1:], at + 1)
        ctx = gram[:-1]
        return below if not total.get(ctx) else (max(n.get(gram, 0) - d, 0) + d * kinds[ctx] * below) / total[ctx]

    def entropy(self, text):
        s = spelled(text)
        return -sum(math.log(self.p(s[i - O + 1 : i + 1])) for i in range(O - 1, len(s))) / max(1, len(s) - O + 1)


@pytest.mark.parametrize("repeat", [1, 50])
def test_entropies_against_dictionaries(repeat):
    rng = random.Random(repeat)
    corpora = [["".join(rng.choice(al) for _ in range(rng.randint(1, 40))) for _ in range(30)] * repeat for al in ("abc d", "bcde ", "xyé z")]
    model = langid.kneser_ney([counted(c) for c in corpora], ["a", "b", "c"])
    texts = ["abc", "abc abd", "qqq zzz", "xyz é", "a", "bcd eeb x1 y", "e" * 300]
    ce, _ = model.entropies(texts)
    want = np.array([[Brute(c).entropy(t) for c in corpora] for t in texts])
    assert np.isfinite(ce).all() and np.abs(ce - want).max() < 1e-4


def test_no_unigram_seen_once_and_no_neighbour_counts():
    """All unigrams follow many characters, so n1 = 0 there: a discount of 0 would leave nothing for what is unseen."""
    corpus = ["".join(p) for p in ("abcd", "badc", "cadb", "dbca", "acbd", "bdac", "cbda", "dcab")] * 40
    model = langid.kneser_ney([counted(corpus)], ["x"])
    texts = ["qqq zzz", "abc", "", "Ω" * 50, "abc abd", " ", "1", "\ud800"]
    together = langid.predict_texts(model, texts)
    assert together == [langid.predict_texts(model, [t])[0] for t in texts]
    assert all(math.isfinite(r[2]) and 0 <= r[1] <= 1 for r in together if r[0] != "und")


@pytest.mark.parametrize("most", [1, 7, 40])
def test_pruned_models_add_up_to_one(most):
    rng = random.Random(most)
    counts = [counted(["".join(rng.choice("abcde ") for _ in range(60)) for _ in range(9)]) for _ in range(2)]
    model = langid.kneser_ney(counts, ["a", "b"], most)
    assert all(len(t.h) <= 2 * most for t in model.p)

    def p(key, lang):
        total = 0.0
        for i, k in enumerate(range(O, 0, -1)):
            kk = langid.low(np.array([key], np.uint64), k)
            row = model.p[i].find(kk)[0]
            if row >= 0:
                return math.exp(total + model.p[i].values[row, lang])
            b = model.b[i].find(kk >> np.uint64(langid._BITS))[0]
            total += model.b[i].values[b, lang] if b >= 0 else 0
        return math.exp(total - math.log(langid.VOCABULARY))

    for ctx in {int(g) >> langid._BITS for g in counts[0][0][:20]}:
        for lang in (0, 1):
            assert abs(sum(p(ctx << langid._BITS | c, lang) for c in range(langid.VOCABULARY)) - 1) < 1e-3


def test_query_on_rows_it_has_not_seen(spark, tmp_path):
    rng = random.Random(6)
    parts = {"aa": ["sha", "the", "ing", "on"], "bb": ["ció", "ñe", "los", "ar"], "cc": ["ung", "sch", "über", "ei"]}
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang, "s"))
    truth = {r[0]: r[2] for r in rows}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    # labels of held-out rows are wrong: nothing may be learned from them
    rows = [(i, t, "zz" if i in held else lang, s) for i, t, lang, s in rows] + [(1000, None, "aa", "s"), (1001, " 1 2", None, "s"), (1002, "", "bb", None), (1003, "the sha " * 20_000, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    r = {x.doc_id: x for x in langid.op8_language_id(spark, str(tmp_path)).collect()}
    assert len(r) == len(rows) and {i for i, x in r.items() if x.held_out and i < 400} == held
    assert sum(r[i].lang_pred == truth[i] for i in held) / len(held) >= 0.98
    assert all(0 <= x.score <= 1 for x in r.values()) and {r[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and r[1003].lang_pred == "aa"
