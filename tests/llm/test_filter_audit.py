from itertools import permutations

import numpy as np
import pytest

from pyrogrid.llm import filter_audit as fa
from pyrogrid.llm.common import prepared

SCHEMA = "doc_id long, text string, lang string, cell string, part string, n long, digest string, good long"
LABELS = "doc_id long, quality int, toxic int, good string"


def naive(rows, labels):
    """Apply the filters one after the other, document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = t.encode().split()
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((lang or "", i in good, i in toxic, fails))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[3][f]]
                left = [d for d in left if not d[3][f]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[3][f] for d in own) - len(gone), sum(d[3][f] and sum(d[3].values()) == 1 for d in own),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(removed_by[order[step - 1]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "own", 7, "d", 3) for i, t, lang in rows], SCHEMA)


def test_audit_equals_filtering_in_every_order(spark):
    prepared(spark)
    draw = np.random.RandomState(13)
    texts = [None, "", " \n", "A B", "é" * 9 + "A", "é" * 8 + "A", "word " * 120, " ".join(map(str, range(100))), " ".join(map(str, range(99))),
             " ".join(map(str, range(130))) + " $", "X" * 40 + " " + " ".join(map(str, range(110))), " ".join(map(str, range(200_000))) + " #", "a b c d"]
    rows = [(int(i), texts[draw.randint(len(texts))], [None, "", "en", "de", "日本"][draw.randint(5)]) for i in draw.randint(0, 60, 120)]
    rows += [(None, texts[7], "en"), (None, texts[7], "en"), (None, None, None), rows[0], rows[0]]
    labels = [(int(i), [0, 1, None][draw.randint(3)], [0, 1, None][draw.randint(3)]) for i in draw.randint(0, 60, 50)] + [(None, 1, 1)]
    found = fa.audit(frame(spark, rows), spark.createDataFrame([(*r, "x") for r in labels], LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): [r[name] for name in fa.FIGURES] for r in found}
    assert len(found) == len(got) == 600 * len({lang or "" for _, _, lang in rows})
    assert got == naive(rows, labels)


def test_empty_tables(spark):
    prepared(spark)
    none = spark.createDataFrame([], LABELS)
    assert fa.audit(frame(spark, [(1, "a", "en")]).limit(0), none).count() == 0
    one = fa.audit(frame(spark, [(1, "a", "en")]), none).collect()
    assert len(one) == 600 and {r.good_lost + r.toxic_lost for r in one} == {0}
    assert {(r.kept, r.removed, r.redundant) for r in one if r.filter_order == "BACDE" and r.step == 2} == {(0, 1, 0)}


def test_contractions_equal_masked_sums():
    tensors = np.random.RandomState(1).randint(0, 9, (2, 3, 2, 2, 2))
    steps, weights = fa.selections("XYZ")
    assert len(steps) == 18
    for name in weights:
        got = fa.contract(tensors, weights[name])
        for k in range(len(steps)):
            want = np.zeros((2, 3), dtype=int)
            for cell in np.ndindex(2, 2, 2):
                want += tensors[(..., *cell)] * int(np.prod([weights[name][k, a, cell[a]] for a in range(3)]))
            assert (got[..., k] == want).all()


@pytest.mark.parametrize("step", [1, 3, 5])
def test_kept_and_removed_add_up(step):
    tensors = np.random.RandomState(2).randint(0, 99, (4, 3, 2, 2, 2, 2, 2))
    steps, found = fa.figures(tensors, "ABCDE")
    at = {s: k for k, s in enumerate(steps)}
    whole = tensors[:, 0].reshape(4, -1).sum(axis=1)
    for order, s in steps:
        if s == step:
            gone = sum(found["removed"][:, at[order, j]] for j in range(1, s + 1))
            assert (found["kept"][:, at[order, s]] + gone == whole).all()
