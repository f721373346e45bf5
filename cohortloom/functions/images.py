"""Array kernels for gray images and masks, in numpy; they run inside mapInPandas."""

from __future__ import annotations

import numpy as np


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = image.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    b = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return a * (1 - fy) + b * fy


def shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area: each new pixel is the mean of what it covers; bilinear where an axis grows."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        low, high = edges[:-1, None], edges[1:, None]
        cover = np.clip(np.minimum(high, np.arange(1, n + 1)) - np.maximum(low, np.arange(n)), 0, None)
        return cover / cover.sum(1, keepdims=True)

    h, w = image.shape
    if height > h or width > w:
        return resize(image, height, width)
    return weights(h, height) @ image.astype(float) @ weights(w, width).T


#: Fixed value: the slope of the cubic kernel.
CUBIC = -0.75


def enlarge(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cubic convolution over four neighbours each way, pixel centres aligned, the border repeated."""

    def weights(n: int, m: int) -> np.ndarray:
        at = (np.arange(m) + 0.5) * n / m - 0.5
        first = np.floor(at).astype(int)
        out = np.zeros((m, n))
        for k in range(-1, 3):
            d = np.abs(at - (first + k))
            near = ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
            far = ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
            np.add.at(out, (np.arange(m), np.clip(first + k, 0, n - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0)))
        return out

    h, w = image.shape
    return weights(h, height) @ image.astype(float) @ weights(w, width).T


#: Fixed values of padding lines: mean and deviation at most, share of values that are dark at least; what may be cut off a side, what must stay.
DARK_MEAN, DARK_DEVIATION, DARK_VALUE, DARK_SHARE = 12.0, 4.0, 20, 0.98
SIDE, STAYS = 0.20, 0.60


def padding_bounds(image: np.ndarray) -> tuple[int, int, int, int]:
    """(top, bottom, left, right) without runs of dark, even lines at the borders; runs under two lines stay."""
    dark = lambda lines: (lines.mean(1) <= DARK_MEAN) & (lines.std(1) <= DARK_DEVIATION) & ((lines <= DARK_VALUE).mean(1) >= DARK_SHARE)

    def cut(lines: np.ndarray) -> tuple[int, int]:
        n = len(lines)
        stays, most, flags = max(8, int(np.ceil(n * STAYS))), int(np.floor(n * SIDE)), dark(lines)
        run = lambda f, room: min(int(np.argmin(np.append(f, False))), most, max(room, 0))
        first = run(flags, n - stays)
        last = run(flags[::-1], n - stays - first)
        return (first if first >= 2 else 0), n - (last if last >= 2 else 0)

    lines = image.astype(np.float32)
    (top, bottom), (left, right) = cut(lines), cut(lines.T)
    return top, bottom, left, right


def robust_scale(image: np.ndarray) -> np.ndarray:
    """The 1st to 99th percentile as 0 to 1; the range where these are equal."""
    a, b = np.percentile(image, [1, 99])
    if b <= a:
        a, b = image.min(), image.max()
    return np.zeros(image.shape) if b <= a else np.clip((image - a) / (b - a), 0, 1)


def canvas(image: np.ndarray, size: int = 256, long_side: int = 240) -> tuple[np.ndarray, np.ndarray]:
    """(image on a square canvas, where it lies): shrunk by area or enlarged by cubic convolution, between 0 and 1."""
    h, w = image.shape
    k = long_side / max(h, w)
    nh, nw = (long_side, max(1, round(w * k))) if h >= w else (max(1, round(h * k)), long_side)
    out, inside = np.zeros((size, size)), np.zeros((size, size), bool)
    y, x = (size - nh) // 2, (size - nw) // 2
    fitted = image if (nh, nw) == (h, w) else shrink(image, nh, nw) if k < 1 else enlarge(image, nh, nw)
    out[y : y + nh, x : x + nw] = np.clip(fitted, 0, 1)
    inside[y : y + nh, x : x + nw] = True
    return out, inside


def standardise(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(robust, raw, content) on the canvas, without padding."""
    t, b, left, r = padding_bounds(image)
    part = image[t:b, left:r].astype(float)
    robust, content = canvas(robust_scale(part))
    raw, _ = canvas(part / 255.0)
    return robust, raw, content


def classifier_views(image: np.ndarray, side: int = 224) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(robust, raw, content) at the side of a classifier: shrunk by area, content by the nearest pixel."""
    robust, raw, content = standardise(image)
    at = np.minimum((np.arange(side) * content.shape[0] / side).astype(int), content.shape[0] - 1)
    return shrink(robust, side, side), shrink(raw, side, side), content[at][:, at]


def perceptual_hash(image: np.ndarray) -> str:
    """16 hex digits: the 64 lowest frequencies of a cosine transform, larger than the median of all but the constant one."""
    k, n = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * (2 * n + 1) * k / 64) * np.where(k == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))
    low = (basis @ shrink(image, 32, 32) @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return f"{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


def _filtered(image: np.ndarray, kernel: list[list[float]]) -> np.ndarray:
    """A 3 x 3 filter; the image is mirrored at its edges."""
    p = np.pad(image.astype(float), 1, mode="reflect")
    h, w = image.shape
    return sum(kernel[i][j] * p[i : i + h, j : j + w] for i in range(3) for j in range(3))


def quality_metrics(image: np.ndarray, side: int = 128) -> dict[str, float | str]:
    """Of the content on the canvas, at 128 pixels: perceptual_hash, sharpness (variance of the Laplacian), noise_ratio, dynamic_range.

    Noise is the robust deviation of what a Gaussian takes away, over the range (1 at least) from the 5th to the 95th percentile. Without content all are missing.
    """
    robust, raw, content = standardise(image)
    if not content.any():
        return {"perceptual_hash": "", "sharpness": float("nan"), "noise_ratio": float("nan"), "dynamic_range": float("nan")}
    rows, columns = np.flatnonzero(content.any(1)), np.flatnonzero(content.any(0))
    part = np.s_[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    even = np.clip(np.round(shrink(robust[part], side, side) * 255), 0, 255)
    plain = np.clip(shrink(raw[part], side, side) * 255, 0, 255)
    left = plain - _filtered(plain, [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]])
    noise = np.median(np.abs(left - np.median(left))) / 0.6744897501960817
    low, up = np.percentile(plain, [5, 95])
    spread = max(float(up - low), 0.0)
    return {"perceptual_hash": perceptual_hash(even), "sharpness": float(_filtered(even, [[0, 1, 0], [1, -4, 1], [0, 1, 0]]).var()), "noise_ratio": float(noise / max(spread, 1.0)), "dynamic_range": spread}


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected parts, 0 outside."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(labels, 1)
        best = np.max([p[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, best, 0)
        if (new == labels).all():
            return labels
        labels = new


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = np.pad(mask, r)
    return np.any([p[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(size) for j in range(size)], axis=0)


def candidate_mask(probability: np.ndarray, threshold: float) -> np.ndarray:
    """Threshold, closing by 5 x 5, largest part."""
    mask = ~dilate(~dilate(np.pad(probability >= threshold, 4), 5), 5)[4:-4, 4:-4]
    if not mask.any():
        return mask
    labels = components(mask)
    names, counts = np.unique(labels[labels > 0], return_counts=True)
    return labels == names[counts.argmax()]


def mask_features(mask: np.ndarray, border: int = 2) -> dict[str, float]:
    """area_ratio, boundary_touch_fraction, centre and aspect."""
    n = int(mask.sum())
    if not n:
        return {"area_ratio": 0.0, "boundary_touch_fraction": 0.0, "centroid_x": float("nan"), "centroid_y": float("nan"), "aspect": float("nan")}
    edge = np.ones(mask.shape, bool)
    edge[border:-border, border:-border] = False
    y, x = np.nonzero(mask)
    return {"area_ratio": n / mask.size, "boundary_touch_fraction": float((mask & edge).sum() / n), "centroid_x": float(x.mean() / max(mask.shape[1] - 1, 1)), "centroid_y": float(y.mean() / max(mask.shape[0] - 1, 1)), "aspect": float((np.ptp(x) + 1) / (np.ptp(y) + 1))}


#: Limits of a mask, steps of the repair, parts of the uncertainty.
AREA_LOW, AREA_HIGH, PEAK_LOW, TOUCH_HIGH, DEVIATION_HIGH = 0.003, 0.65, 0.50, 0.35, 5.5
STEPS = (-0.20, -0.15, -0.10, -0.05, 0.05, 0.10, 0.15, 0.20)
PRIOR_FEATURES, PRIOR_ROWS = ("area_ratio", "centroid_x", "centroid_y", "aspect"), 5


def prior_deviation(mask: np.ndarray, prior: dict | None) -> float:
    """The largest distance of a feature from its prior centre, in prior scales; 0 without a mask or with fewer than five prior rows.

    prior: n, and (centre, scale) by feature.
    """
    if not prior or prior.get("n", 0) < PRIOR_ROWS or not mask.any():
        return 0.0
    f = mask_features(mask)
    return float(max((abs(f[k] - prior[k][0]) / prior[k][1] for k in PRIOR_FEATURES if k in prior), default=0.0))


def mask_reason(area: float, peak: float, touch: float, deviation: float) -> str:
    """Names of the limits that a mask breaks."""
    rules = (("area_too_small", area < AREA_LOW), ("area_too_large", area > AREA_HIGH), ("low_peak_probability", peak < PEAK_LOW), ("touches_boundary", touch > TOUCH_HIGH), ("geometry_outlier", deviation > DEVIATION_HIGH))
    return ";".join(name for name, bad in rules if bad)


def repair(probability: np.ndarray, threshold: float, prior: dict | None = None) -> dict:
    """The best mask near a threshold: valid before invalid, then by probability inside less half the share on the border and 0.06 of the deviation (10 at most).

    Cuts are tried upwards, and of equal ones the first stays. Gives mask, valid, method, threshold, reason, deviation.
    """
    peak, best = float(probability.max()), None
    for cut in sorted({threshold, *(float(np.clip(threshold + step, 0.05, 0.95)) for step in STEPS)}):
        mask = candidate_mask(probability, cut)
        f, away = mask_features(mask), prior_deviation(mask, prior)
        why = mask_reason(f["area_ratio"], peak, f["boundary_touch_fraction"], away)
        inside = float(probability[mask].mean()) if mask.any() else 0.0
        rank = (why == "", inside - 0.50 * f["boundary_touch_fraction"] - 0.06 * min(away, 10.0))
        if best is None or rank > best[0]:
            best = rank, {"mask": mask, "valid": why == "", "method": "adaptive_threshold_with_fold_prior" if why == "" else "unresolved", "threshold": cut, "reason": why, "deviation": away}
    return best[1]


def predict(probability: np.ndarray, presence: float, presence_threshold: float, threshold: float, prior: dict | None = None) -> dict:
    """The mask of a probability map: empty if presence is low and no pixel is certain; the first cut if it is valid; else the repair."""
    if not (presence >= presence_threshold or float(probability.max()) >= 0.80):
        return {"mask": np.zeros(probability.shape, bool), "valid": True, "method": "presence_head_empty", "threshold": threshold, "reason": "", "deviation": 0.0}
    mask = candidate_mask(probability, threshold)
    f, away = mask_features(mask), prior_deviation(mask, prior)
    why = mask_reason(f["area_ratio"], float(probability.max()), f["boundary_touch_fraction"], away)
    if why == "":
        return {"mask": mask, "valid": True, "method": "none", "threshold": threshold, "reason": "", "deviation": away}
    out = repair(probability, threshold, prior)
    return out | {"method": "photometric_tta+" + out["method"]}


def uncertainty(probability: np.ndarray, other: np.ndarray, presence: float, presence_threshold: float, deviation: float, valid: bool) -> tuple[float, float, float]:
    """(disagreement, entropy, uncertainty): mean difference of two maps, mean entropy in bits of the most uncertain tenth, and their mix with the doubt about presence and the deviation."""
    p = np.clip(probability.astype(float), 1e-6, 1 - 1e-6)
    e = np.sort((-(p * np.log2(p) + (1 - p) * np.log2(1 - p))).ravel())
    entropy, apart = float(e[-max(1, round(0.10 * e.size)) :].mean()), float(np.abs(p - other).mean())
    doubt = max(0.0, 1 - abs(presence - presence_threshold) / 0.50)
    mix = 0.35 * entropy + 0.35 * min(1.0, apart / 0.08) + 0.20 * doubt + 0.10 * min(1.0, deviation / DEVIATION_HIGH) + (0.0 if valid else 0.15)
    return apart, entropy, min(1.0, mix)


def support(mask: np.ndarray, content: np.ndarray, size: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(region around the mask, the rest of the content)."""
    near = dilate(mask, size) & content
    return near, content & ~near


def histogram_limits(image: np.ndarray, mask: np.ndarray, q: tuple[float, float] = (0.01, 0.99)) -> tuple[float, float] | None:
    """Values of the given ranks inside the mask, from 256 bins; None for too few pixels or none between."""
    v = np.clip(np.round(np.clip(image[mask], 0, 1) * 255).astype(int), 0, 255)
    if len(v) < 64:
        return None
    total = np.cumsum(np.bincount(v, minlength=256))
    a, b = (int(np.searchsorted(total, int(np.floor(p * (len(v) - 1))) + 1)) for p in q)
    return None if b <= a else (a / 255, b / 255)


def region_normalise(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The masked image from its lower to its upper limit (eight grey levels apart at least) as 0 to 1; all 0 without limits."""
    limits = histogram_limits(image, mask)
    if limits is None:
        return np.zeros(image.shape)
    return np.clip((image - limits[0]) / max(limits[1] - limits[0], 8 / 255), 0, 1) * mask


def confusion(truth: np.ndarray, guess: np.ndarray) -> tuple[int, int, int]:
    """(both, guess only, truth only)."""
    return int((truth & guess).sum()), int((guess & ~truth).sum()), int((truth & ~guess).sum())


def pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpack(raw: bytes, side: int = 256) -> np.ndarray:
    if len(raw) * 8 != side * side:
        raise ValueError(f"a mask has {side * side // 8} bytes, not {len(raw)}")
    return np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(side, side).astype(bool)


def mask_of(gray: np.ndarray, side: int = 256) -> np.ndarray:
    """The pixels over 127 at side x side, each the nearest one."""
    h, w = gray.shape
    y, x = ((np.arange(side) * n / side).astype(int).clip(0, n - 1) for n in (h, w))
    return gray[y][:, x] > 127


def stack(previous: np.ndarray, current: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Three neighbours of a sequence as channels."""
    return np.stack([previous, current, following])
