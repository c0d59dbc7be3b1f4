import random

import numpy as np

from curatrix.operators import evaluation as ev

P = "image int, class_id int, conf double, pred bigint, x1 double, y1 double, x2 double, y2 double"
T = "image int, class_id int, truth bigint, x1 double, y1 double, x2 double, y2 double"


def preds(spark, rows):
    return spark.createDataFrame([(i, c, float(s), n, *map(float, b)) for i, c, s, n, b in rows], P)


def truths(spark, rows):
    return spark.createDataFrame([(i, c, n, *map(float, b)) for i, c, n, b in rows], T)


BOX = (0, 0, 10, 10)


def spatial(spark, t, p):
    found = ev.match_spatial(preds(spark, p), truths(spark, t))
    return sorted((r["truth"], r["pred"]) for r in found.collect())


def test_spatial_fixtures(spark):
    assert spatial(spark, [(1, 0, 0, BOX)], [(1, 1, 0.9, 0, BOX), (1, 0, 0.8, 1, BOX)]) == [(0, 0)]
    assert spatial(spark, [], [(1, 0, 0.9, 0, BOX)]) == [] and spatial(spark, [(1, 0, 0, BOX)], []) == []
    assert spatial(spark, [(1, 0, 0, BOX)], [(1, 0, 0.9, 0, (0, 0, 5, 10))]) == [(0, 0)]


def test_ties(spark):
    t = truths(spark, [(1, 0, 5, BOX), (1, 0, 6, BOX)])
    p = preds(spark, [(1, 0, 0.5, 2, BOX), (1, 0, 0.5, 1, BOX), (1, 0, 0.5, 3, BOX)])
    assert {(r["pred"], r["truth"]) for r in ev.match_by_class(p, t).collect()} == {(1, 5), (2, 6)}
    assert {(r["pred"], r["truth"]) for r in ev.match_by_class(p, t, last_truth_wins=True).collect()} == {(1, 6), (2, 5)}


def some(seed):
    rnd = random.Random(seed)
    box = lambda: (lambda x, y: (x, y, x + rnd.choice([8, 10, 12]), y + rnd.choice([8, 10, 12])))(rnd.randint(0, 12), rnd.randint(0, 12))
    t = [(rnd.randint(1, 6), rnd.randint(0, 2), k, box()) for k in range(40)]
    p = [(rnd.randint(1, 7), rnd.randint(0, 3), rnd.randint(1, 20) / 20, k, box()) for k in range(90)]
    return t, p


def iou(a, b):
    ov = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return ov / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - ov)


def plain_match(t, p, least, last=False):
    used, out = set(), {}
    for i, c, _, n, b in sorted(p, key=lambda r: (-r[2], r[3])):
        best, which = least, None
        for ti, tc, k, tb in t:
            if (ti, tc) == (i, c) and k not in used:
                v = iou(b, tb)
                if v > best or (v == best and (which is None or last)):
                    best, which = v, k
        if which is not None:
            used.add(which)
            out[n] = which
    return out


def test_class_aware_as_plain_version(spark):
    t, p = some(4)
    assert {r["pred"]: r["truth"] for r in ev.match_by_class(preds(spark, p), truths(spark, t)).collect()} == plain_match(t, p, 0.5)


def test_conservation(spark):
    t, p = some(5)
    pd, td = preds(spark, p), truths(spark, t)
    flagged = ev.flags(pd, td)
    for matrix in (ev.confusion_by_class(flagged, td), ev.confusion_spatial(pd, td)):
        rows = matrix.collect()
        assert sum(r["n"] for r in rows if r["true_class"] >= 0) == len(t) and sum(r["n"] for r in rows if r["pred_class"] >= 0) == len(p)
        assert not [r for r in rows if r["pred_class"] == r["true_class"] == ev.BACKGROUND]
    classes = spark.createDataFrame([(c,) for c in range(5)], "class_id int")
    scores = {r["class_id"]: r for r in ev.per_class(flagged, td, classes).collect()}
    assert scores[4]["support"] == 0 and scores[4]["precision"] == 0 and scores[None]["tp"] == sum(scores[c]["tp"] for c in range(5))
    assert sum(r["fn"] + r["tp"] for r in ev.per_image(flagged, td).collect()) == len(t)
    low = {r["class_id"]: r for r in ev.curve(flagged, td, [0.0, 0.5]).collect() if r["threshold"] == 0.0}
    assert low[None]["n"] == len(p) and low[None]["tp"] == scores[None]["tp"]
    wide = ev.matrix(ev.confusion_spatial(pd, td), [0, 1, 2, 3]).collect()
    assert len(wide) == 5 and sum(sum(tuple(r)[1:]) for r in wide) == sum(r["n"] for r in ev.confusion_spatial(pd, td).collect())


def plain_ap(t, p, least, most):
    out = {}
    for c in {x[1] for x in t}:
        dets = []
        for i in {x[0] for x in p}:
            dets += sorted((x for x in p if x[0] == i and x[1] == c), key=lambda r: (-r[2], r[3]))[:most]
        hits = plain_match([x for x in t if x[1] == c], dets, least, last=True)
        dets.sort(key=lambda r: (-r[2], r[0], r[3]))
        tp = np.cumsum([d[3] in hits for d in dets])
        support = sum(x[1] == c for x in t)
        recall, precision = tp / support, tp / np.arange(1, len(dets) + 1)
        best = np.maximum.accumulate(precision[::-1])[::-1] if len(dets) else precision
        at = np.searchsorted(recall, np.linspace(0, 1, 101), side="left")
        out[c] = float(np.mean([best[k] if k < len(best) else 0.0 for k in at]))
    return out


def test_average_precision_as_plain_version(spark):
    t, p = some(6)
    got = {(r["class_id"], r["threshold"]): r["ap"] for r in ev.average_precision(preds(spark, p), truths(spark, t), most=5, thresholds=[0.5, 0.75]).collect()}
    for least in (0.5, 0.75):
        want = plain_ap(t, p, least, 5)
        assert {c for c, x in got if x == least} == set(want)
        assert all(abs(got[c, least] - v) < 1e-9 for c, v in want.items())


def test_checks(spark):
    p = preds(spark, [(1, 0, 0.25, 1, BOX), (1, 0, 1.5, 2, BOX), (1, 0, 0.5, 3, (0, 0, float("inf"), 1))])
    assert sorted(r["pred"] for r in ev.invalid_predictions(p).collect()) == [2, 3]
    assert [tuple(r) for r in ev.crowded_images(p, 2).collect()] == [(1, 3)]
    history = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, None)], "epoch int, `m(B)` double")
    assert ev.best_epoch(history, "`m(B)`")["epoch"] is not None and ev.best_epoch(history, "`m(B)`").first()["epoch"] == 2
