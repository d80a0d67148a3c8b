"""Quality measures as Columns of the counts TP, FP, FN and TN (or their soft forms)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / F.when(b != 0, b))


def tpr(tp, fp, fn, tn):
    """1 without misses, 0 without hits."""
    return F.when(fn == 0, 1.0).when(tp == 0, 0.0).otherwise(_ratio(tp, tp + fn))


def fpr(tp, fp, fn, tn):
    return F.when(fp == 0, 0.0).otherwise(_ratio(fp, fp + tn))


def fnr(tp, fp, fn, tn):
    return F.when(fn == 0, 0.0).otherwise(_ratio(fn, tp + fn))


def tnr(tp, fp, fn, tn):
    return F.when(fp == 0, 1.0).when(tn == 0, 0.0).otherwise(_ratio(tn, fp + tn))


def ppv(tp, fp, fn, tn):
    return F.when(fp == 0, 1.0).when(tp == 0, 0.0).otherwise(_ratio(tp, tp + fp))


def npv(tp, fp, fn, tn):
    return F.when(fn == 0, 1.0).when(tn == 0, 0.0).otherwise(_ratio(tn, tn + fn))


def accuracy(tp, fp, fn, tn):
    return _ratio(tp + tn, tp + fp + fn + tn)


def wracc(tp, fp, fn, tn):
    """Weighted relative accuracy, moved from [-1, 1] to [0, 1]; null if nothing is in the group."""
    n = tp + fp + fn + tn
    return (_ratio(tp + fp, n) * (_ratio(tp, tp + fp) - _ratio(tp + fn, n)) + 1) / 2


def roc_accuracy(tp, fp, fn, tn):
    return (tpr(tp, fp, fn, tn) - fpr(tp, fp, fn, tn) + 1) / 2


def kappa(tp, fp, fn, tn):
    """Cohen's kappa."""
    n = tp + fp + fn + tn
    e = _ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return _ratio(accuracy(tp, fp, fn, tn) - e, 1 - e)


def kappa_of_cells(tp, fp, fn, tn):
    """The variant whose chance term multiplies group sizes with the hits in them."""
    n = tp + fp + fn + tn
    e = _ratio((fn + tn) * tn + (tp + fp) * tp, n * n)
    return _ratio(accuracy(tp, fp, fn, tn) - e, 1 - e)


def f1(precision, recall):
    return F.when(precision + recall == 0, 0.0).otherwise(_ratio(2 * precision * recall, precision + recall))


def lift(tp, fp, fn, tn):
    return _ratio(ppv(tp, fp, fn, tn), _ratio(tp + fn, tp + fp + fn + tn))


def plr(tp, fp, fn, tn):
    """Positive likelihood ratio, in [0, 1]."""
    t = tpr(tp, fp, fn, tn)
    return _ratio(t, t + _ratio(fp, fp + tn))


def balanced_precision(precision, recall):
    return 0.5 * recall + 0.5 * precision


def all_measures(tp, fp, fn, tn) -> dict[str, Column]:
    """The measures of a group, rounded to four places; F1 and balanced precision are of rounded parts."""
    r = lambda c: F.round(c, 4)
    a = (tp, fp, fn, tn)
    pre, rec = r(ppv(*a)), r(tpr(*a))
    out = {"accuracy": r(accuracy(*a)), "roc_accuracy": r(roc_accuracy(*a)), "wracc": r(wracc(*a)), "kappa": r(kappa_of_cells(*a)), "f1": r(f1(pre, rec)), "normalized_plr": r(plr(*a)), "balanced_precision": r(balanced_precision(pre, rec))}
    mean = sum(out.values()) / len(out)
    return out | {"lift": r(lift(*a)), "ensemble": r(mean)}
