"""Per-row losses and matching costs as expressions; p is a probability, x a logit, t a 0/1 target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g

EPS = 1e-12


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cross_entropy(p: Column, t: Column) -> Column:
    return -(t * F.log(F.greatest(p, F.lit(EPS))) + (1 - t) * F.log(F.greatest(1 - p, F.lit(EPS))))


def focal(p: Column, t: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    miss = (1 - p) * t + p * (1 - t)
    return cross_entropy(p, t) * (alpha * t + (1 - alpha) * (1 - t)) * F.pow(miss, F.lit(gamma))


def varifocal(p: Column, q: Column, gamma: float = 2.0, alpha: float = 0.75) -> Column:
    return cross_entropy(p, q) * F.when(q > 0, q).otherwise(alpha * F.pow(p, F.lit(gamma)))


def quality_focal(p: Column, q: Column, beta: float = 2.0) -> Column:
    return cross_entropy(p, q) * F.pow(F.abs(q - p), F.lit(beta))


def l1(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def smooth_l1(a: Column, b: Column, beta: float = 1.0) -> Column:
    d = F.abs(a - b)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def balanced_l1(a: Column, b: Column, alpha: float = 0.5, gamma: float = 1.5, beta: float = 1.0) -> Column:
    import math

    d = F.abs(a - b)
    e = math.e ** (gamma / alpha) - 1
    return F.when(d < beta, alpha / e * (e * d + 1) * F.log(e * d / beta + 1) - alpha * d).otherwise(gamma * d + gamma / e - alpha * beta)


def mse(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def dice_loss(inter: Column, a: Column, b: Column, eps: float = 1e-6, scale: float = 1000.0) -> Column:
    """From sums over a mask: of products, of predictions and of targets."""
    return 1 - (2 * inter / scale + eps) / (a / scale + b / scale + eps)


def iou_loss(a: g.Box, b: g.Box, kind: str = "log", eps: float = 1e-6) -> Column:
    i = F.greatest(g.iou(a, b, 0, eps), F.lit(eps))
    return {"log": -F.log(i), "linear": 1 - i, "square": 1 - i * i, "giou": 1 - g.giou(a, b), "diou": 1 - g.diou(a, b), "ciou": 1 - g.ciou(a, b)}[kind]


def box_l1_cost(a: g.Box, b: g.Box, w: Column, h: Column) -> Column:
    parts = [F.abs(x - y) / s for x, y, s in zip(g.to_center(a), g.to_center(b), (w, h, w, h), strict=True)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def focal_cost(p: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    neg = -F.log(1 - p + EPS) * (1 - alpha) * F.pow(p, F.lit(gamma))
    return -F.log(p + EPS) * alpha * F.pow(1 - p, F.lit(gamma)) - neg
