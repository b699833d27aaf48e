"""Kernels over batches of frames: arrays of n frames of one shape, `(n, height, width, 3)` of octets, red, green and blue.

All frames of a batch go through each kernel together. Boxes are left, top, right and bottom in shares of a frame's size. Every result has an entry a frame;
ratios lie between 0 and 1. Frames of any size from one pixel on are taken; detectors that need more see nothing on smaller ones.

Tests of a colour (bands of hue, fills, tracks, cards) are worked out once for each colour that occurs and kept in a table of words, from which all pixels look theirs up; a `View` shares the
words of its frames among their regions.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import cache, cached_property

import numpy as np

# Regions of a frame.
REGIONS = {
    "list_rows": (0.05, 0.17, 0.95, 0.92), "detail_card": (0.04, 0.38, 0.96, 0.98), "name": (0.14, 0.32, 0.86, 0.43), "hp": (0.22, 0.39, 0.78, 0.48),
    "hp_bar": (0.18, 0.385, 0.82, 0.425), "hp_text": (0.18, 0.415, 0.82, 0.49), "tag": (0.06, 0.44, 0.94, 0.55), "pokemon_art": (0.10, 0.08, 0.90, 0.37),
    "moves": (0.05, 0.63, 0.95, 0.99), "moves_tabs": (0.18, 0.765, 0.82, 0.82), "moves_fast_row": (0.05, 0.80, 0.95, 0.88), "moves_charged_rows": (0.05, 0.88, 0.95, 0.99),
    "moves_complete_rows": (0.05, 0.87, 0.95, 0.99), "moves_completion_footer": (0.05, 0.84, 0.95, 0.98), "moves_new_attack_button": (0.05, 0.84, 0.95, 0.98), "moves_transition_guard": (0.05, 0.62, 0.45, 0.88),
    "story": (0.03, 0.74, 0.97, 0.98), "appraisal_badge": (0.00, 0.53, 0.43, 0.84), "iv_panel": (0.08, 0.74, 0.56, 0.90), "horizontal_swipe_card": (0.00, 0.38, 1.00, 0.95), "sequence_motion": (0.10, 0.28, 0.90, 0.48),
}
# Where the regions of moves lie beside an anchor of their tab: left, top and bottom from the anchor on, right.
MOVES_BY_TAB = {
    "moves_tabs": (0.18, -0.045, 0.020, 0.82), "moves_fast_row": (0.05, 0.012, 0.075, 0.95), "moves_charged_rows": (0.05, 0.070, 0.140, 0.95), "moves_complete_rows": (0.05, 0.070, 0.175, 0.95),
    "moves_completion_footer": (0.05, 0.105, 0.245, 0.95), "moves_new_attack_button": (0.06, 0.155, 0.235, 0.44), "moves_transition_guard": (0.05, -0.145, 0.030, 0.45),
}
# Heights of the three bars within their panel, in two layouts; the stars of a badge.
UPPER_BARS = {"iv_attack": (0.02, 0.20), "iv_defense": (0.25, 0.48), "iv_stamina": (0.50, 0.73)}
LOWER_BARS = {"iv_attack": (0.12, 0.35), "iv_defense": (0.35, 0.58), "iv_stamina": (0.58, 0.84)}
STARS = ((0.12, 0.46, 0.30, 0.62), (0.26, 0.40, 0.45, 0.55), (0.40, 0.35, 0.60, 0.50))
# Hue in degrees from and to, least saturation and value.
BAR_COLOURED, BAR_ORANGE = (0, 360, 0.08, 0.35), (10, 55, 0.20, 0.35)
GREEN, ORANGE, REDS, COLOURED = (70, 165, 0.12, 0.50), (10, 55, 0.30, 0.45), ((340, 360, 0.18, 0.35), (0, 10, 0.18, 0.35)), (0, 360, 0.18, 0.55)
SPLIT_ROWS = (0.38, 0.395)


def cut(frames: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of each frame in a box; at least one pixel."""
    height, width = frames.shape[1:3]
    left, top = (max(0, min(size - 1, int(share * size))) for share, size in ((box[0], width), (box[1], height)))
    right, bottom = max(left + 1, min(width, int(box[2] * width))), max(top + 1, min(height, int(box[3] * height)))
    if isinstance(frames, View):
        return View(frames.frames[:, top:bottom, left:right], lambda: frames.words[:, top:bottom, left:right])
    return frames[:, top:bottom, left:right]


def luma(frames: np.ndarray) -> np.ndarray:
    """Grey values of whole numbers, by the weights of ITU-R 601."""
    if isinstance(frames, View):
        return frames.words.astype(np.uint8)
    out, part = frames[..., 0].astype(np.uint32), np.empty(frames.shape[:-1], np.uint32)
    out *= np.uint32(19595)
    for c, weight in ((1, 38470), (2, 7471)):
        part[...] = frames[..., c]
        part *= np.uint32(weight)
        out += part
    out += np.uint32(0x8000)
    out >>= 16
    return out.astype(np.uint8)


_BITS = 22


@cache
def _taps(size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """A triangle filter from `size` samples to `wanted`, wider when it shrinks: the samples that each result reads, and their weights in whole parts of 2^22."""
    scale = size / wanted
    reach = max(scale, 1.0)
    places, weights = [], []
    for i in range(wanted):
        middle = (i + 0.5) * scale
        first, last = max(0, int(middle - reach + 0.5)), min(size, int(middle + reach + 0.5))
        w = np.maximum(0, 1 - np.abs((np.arange(first, last) - middle + 0.5) / reach))
        places.append(np.arange(first, last))
        weights.append(np.floor(w / w.sum() * (1 << _BITS) + 0.5).astype(np.int32))
    most = max(map(len, places))
    return np.array([np.pad(x, (0, most - len(x)), "edge") for x in places]).T.copy(), np.array([np.pad(x, (0, most - len(x))) for x in weights]).T.copy()


def _filtered(lines: np.ndarray, taps: tuple[np.ndarray, np.ndarray], axis: int) -> np.ndarray:
    """Octets weighted along an axis of a matrix. Sums stay below 2^31: weights add up to 2^22 and some halves. Rows that equal the one before, as empty stretches of a screen do, are weighted once."""
    if axis and len(lines) > 1:
        new = np.r_[True, (lines[1:] != lines[:-1]).any(1)]
        if 2 * np.count_nonzero(new) <= len(lines):
            return _filtered(lines[new], taps, axis)[np.cumsum(new) - 1]
    wide, shape = lines.astype(np.int32), list(lines.shape)
    shape[axis] = taps[0].shape[1]
    out = np.full(shape, 1 << (_BITS - 1), np.int32)
    part = np.empty_like(out)
    for place, weight in zip(*taps):
        some = np.flatnonzero(weight)
        if 4 * len(some) < len(weight):  # the last taps reach few results
            at = (slice(None), some) if axis else some
            out[at] += wide.take(place[some], axis) * (weight[some] if axis else weight[some, None])
            continue
        wide.take(place, axis, out=part, mode="clip")
        part *= weight if axis else weight[:, None]
        out += part
    out >>= _BITS
    return np.minimum(out, 255, out=out).astype(np.uint8)


@cache
def _wide_taps(size: int, wanted: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """_taps of lines whose samples have several parts."""
    place, weight = _taps(size, wanted)
    return (place[..., None] * depth + np.arange(depth)).reshape(len(place), -1), np.repeat(weight, depth, 1)


def resized(frames: np.ndarray, width: int, height: int) -> np.ndarray:
    """Frames, coloured or grey, at another size: columns first, then rows, rounded to octets after each."""
    n, high, wide = frames.shape[:3]
    depth = 1 if frames.ndim == 3 else frames.shape[3]
    out = np.empty((n, height, width, *frames.shape[3:]), np.uint8)
    for i, frame in enumerate(frames):
        lines = frame.reshape(high, wide * depth)
        if wide != width:
            lines = _filtered(lines, _wide_taps(wide, width, depth), 1)
        out[i] = (_filtered(lines, _taps(high, height), 0) if high != height else lines).reshape(out.shape[1:])
    return out


def sampled(frames: np.ndarray, most_wide: int = 180, most_high: int = 320) -> np.ndarray:
    """Frames shrunk to fit, in their proportions; small ones stay."""
    height, width = frames.shape[1:3]
    if width <= most_wide and height <= most_high:
        return frames
    if isinstance(frames, View):
        return frames.sampled(most_wide, most_high)
    ratio = min(most_wide / width, most_high / height)
    return resized(frames, max(1, int(width * ratio)), max(1, int(height * ratio)))


def share(mask: np.ndarray) -> np.ndarray:
    """The share of true pixels of each frame."""
    return np.array([np.count_nonzero(m) for m in mask]) / (mask.size // len(mask)) if mask.size else np.zeros(len(mask))


def _row_shares(mask: np.ndarray) -> np.ndarray:
    """The share of true pixels of each row; whole numbers of singles add up exactly."""
    return (mask.astype(np.float32) @ np.ones(mask.shape[2], np.float32)).astype(np.float64) / mask.shape[2]


def brightness(frames: np.ndarray) -> np.ndarray:
    grey = luma(_view(frames))
    return np.array([int(g.sum(dtype=np.uint32)) for g in grey]) / max(1, grey[:1].size) / 255


def dark(frames: np.ndarray, below: int) -> np.ndarray:
    return share(luma(_view(frames)) < below)


def light(frames: np.ndarray, least: int) -> np.ndarray:
    return share(luma(_view(frames)) >= least)


def edges(frames: np.ndarray, least: int = 32) -> np.ndarray:
    """The share of pixels that differ from their eight neighbours by `least` in all; the outermost count by their own grey value."""
    grey = luma(sampled(_view(frames))).astype(np.int16)
    out = grey.copy()
    if min(grey.shape[1:]) > 2:
        rows = grey[:, :-2] + grey[:, 1:-1] + grey[:, 2:]
        around = rows[..., :-2] + rows[..., 1:-1]
        around += rows[..., 2:]
        out[:, 1:-1, 1:-1] = 9 * grey[:, 1:-1, 1:-1] - around
    return share(out >= least)


def hsv(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value in octets."""
    wide = frames.astype(np.float32)
    red, green, blue = wide[..., 0], wide[..., 1], wide[..., 2]
    high, low = wide.max(-1), wide.min(-1)
    spread = high - low
    some = np.where(spread > 0, spread, 1)
    to = lambda c: ((high - c) / some).astype(np.float64)
    hue = np.where(red == high, to(blue) - to(green), np.where(green == high, 2.0 + to(red) - to(blue), 4.0 + to(green) - to(red))).astype(np.float32)
    hue = np.fmod(hue.astype(np.float64) / 6.0 + 1.0, 1.0).astype(np.float32)
    flat = spread == 0
    octet = lambda x: np.where(flat, 0, (x.astype(np.float64) * 255.0).astype(np.int32))  # noqa: E731  (halves of singles would round up)
    return octet(hue), octet(spread / np.maximum(high, 1)), high.astype(np.int32)


def hues(frames: np.ndarray, band: tuple[float, float, float, float]) -> np.ndarray:
    """The share of pixels within one of BANDS that are saturated and bright enough."""
    return share(sampled(_view(frames)).has(_BIT[band]))


def saturated(frames: np.ndarray) -> np.ndarray:
    return share(sampled(_view(frames)).has(_BIT["saturated"]))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, start and end (exclusive) of each run of true values in a matrix."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1]


def _extremes(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return frames.max(-1).astype(np.int32), frames.min(-1).astype(np.int32)


def bar_anchors(frames: np.ndarray) -> dict[str, np.ndarray]:
    """Bars of hit points: runs of 2 to 16 rows with a tenth of coloured pixels and 18 % in one row. anchor_y is the middle of the first (NaN: none), anchor_score its best row (or the best of all rows), anchors their number."""
    small = sampled(_view(frames))
    n, height, width = small.shape[:3]
    left, top = int(width * 0.18), int(height * 0.10)
    part = small.has(_BIT["bar"], np.s_[:, top : max(top + 1, int(height * 0.78)), left : max(left + 1, int(width * 0.82))])
    score = _row_shares(part) if part.size else np.zeros((n, 1))
    row, start, end = runs(score >= 0.10)
    best = np.array([score[r, s:e].max() for r, s, e in zip(row, start, end)])
    fits = (end - start >= 2) & (end - start <= 16) & (best >= 0.18) if len(row) else np.zeros(0, bool)
    row, start, end, best = row[fits], start[fits], end[fits], best[fits]
    y, found = np.full(n, np.nan), score.max(1)
    frame, first = np.unique(row, return_index=True)
    y[frame] = ((2 * top + start[first] + end[first] - 1) / 2) / max(1, height - 1)
    found[frame] = best[first]
    return {"anchor_y": y, "anchor_score": found, "anchors": np.bincount(row, minlength=n)}


def bright_bands(frames: np.ndarray) -> np.ndarray:
    """How many bands of rows, a third of them bright, are high enough."""
    grey = luma(sampled(_plain(frames), 160, 320))
    height = grey.shape[1]
    if height < 12:
        return np.zeros(len(grey), np.int64)
    row, start, end = runs(_row_shares(grey >= 218) >= 0.35)
    return np.bincount(row[end - start >= max(8, int(height * 0.035))], minlength=len(grey))


def dim_columns(frames: np.ndarray) -> np.ndarray:
    """The longest run of columns that are bright in less than 45 % of their rows, as a share of the columns between the margins."""
    grey = luma(sampled(_plain(frames), 180, 180))
    height, width = grey.shape[1:]
    if width < 12 or height < 12:
        return np.zeros(len(grey))
    part = grey[:, :, int(width * 0.05) : int(width * 0.95)]
    row, start, end = runs(_row_shares((part > 235).swapaxes(1, 2)) < 0.45)
    longest = np.zeros(len(grey), np.int64)
    np.maximum.at(longest, row, end - start)
    return longest / max(1, part.shape[2])


def _true_hsv(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value as shares, unrounded."""
    wide = frames.astype(np.float64) / 255
    red, green, blue = wide[..., 0], wide[..., 1], wide[..., 2]
    high, low = wide.max(-1), wide.min(-1)
    spread = high - low
    some = np.where(spread > 0, spread, 1)
    to = lambda c: (high - c) / some
    hue = np.where(red == high, to(blue) - to(green), np.where(green == high, 2.0 + to(red) - to(blue), 4.0 + to(green) - to(red)))
    return np.where(spread > 0, np.mod(hue / 6, 1) * 360, 0), np.where(spread > 0, spread / np.where(high > 0, high, 1), 0), high


# Words of colours: a grey value, and a bit for each test that a colour passes or not.

# The bands that hues tells.
BANDS = (GREEN, ORANGE, *REDS, COLOURED, BAR_COLOURED, BAR_ORANGE)
_BIT = {k: 1 << (8 + i) for i, k in enumerate((*BANDS, "saturated", "bar", "card", "fill", "track", "pale", "dim", "dark", "known"))}


@cache
def _table() -> np.ndarray:
    """The words of all colours, 0 until a colour occurs: 64 MB at most, once a process."""
    return np.zeros(1 << 24, np.uint32)


def _judged(colours: np.ndarray) -> np.ndarray:
    """The words of colours 0xRRGGBB."""
    octets = np.stack([colours >> 16, colours >> 8 & 255, colours & 255], -1).astype(np.uint8)
    (hue, saturation, value), (true_hue, true_saturation, true_value) = hsv(octets), _true_hsv(octets)
    (high, low), degrees = _extremes(octets), hue * 360 / 255
    passed: dict[object, np.ndarray] = {b: (degrees >= b[0]) & (degrees <= b[1]) & (saturation / 255 >= b[2]) & (value / 255 >= b[3]) for b in BANDS}
    passed["saturated"] = (saturation >= 45) & (value >= 70)
    passed["bar"] = ((high - low) / np.maximum(1, high) >= 0.08) & (high / 255 >= 0.35)
    passed["card"] = ((high >= 235) & (low >= 225) & ((high - low) / np.maximum(1, high) <= 0.10)) | ((true_hue >= 70) & (true_hue <= 165) & (true_saturation >= 0.08) & (true_value >= 0.35))
    passed["fill"] = (true_saturation >= 0.18) & (true_value >= 0.35) & ((true_hue <= 55) | (true_hue >= 335))
    passed["track"] = passed["fill"] | ((high >= 65) & (high <= 235) & (high - low <= 70))
    passed["pale"] = (true_saturation < 0.13) & (true_value >= 0.45) & (true_value <= 0.90)
    passed["dim"], passed["dark"], passed["known"] = high <= 160, high <= 150, np.ones(len(octets), bool)
    words = luma(octets).astype(np.uint32)
    for k, bit in _BIT.items():
        words |= passed[k].astype(np.uint32) * np.uint32(bit)
    return words


def coded(frames: np.ndarray) -> np.ndarray:
    """The word of each pixel."""
    at = frames[..., 0].astype(np.intp)
    for c in (1, 2):
        at <<= 8
        at |= frames[..., c]
    table = _table()
    words = table.take(at, mode="clip")  # no index is out of the table
    if not words.all():
        new = np.unique(at[words == 0])
        for i in range(0, len(new), 1 << 16):
            some = new[i : i + (1 << 16)]
            table[some] = _judged(some)
        words = table.take(at, mode="clip")
    return words


class View:
    """Frames, or a part of each, with the words of their pixels, which are looked up when first asked for and shared by parts."""

    def __init__(self, frames: np.ndarray, words: Callable[[], np.ndarray] | None = None):
        self.frames, self._make, self._small = frames, words or (lambda: coded(frames)), {}

    @cached_property
    def words(self) -> np.ndarray:
        return self._make()

    @property
    def shape(self) -> tuple[int, ...]:
        return self.frames.shape

    def __len__(self) -> int:
        return len(self.frames)

    def has(self, bit: int, where: object = np.s_[:]) -> np.ndarray:
        return (self.words[where] & np.uint32(bit)) != 0

    def taken(self, rows: np.ndarray) -> View:
        return View(self.frames[rows], lambda: self.words[rows])

    def sampled(self, most_wide: int, most_high: int) -> View:
        key = most_wide, most_high
        if key not in self._small:
            self._small[key] = View(sampled(self.frames, most_wide, most_high))
        return self._small[key]


def _view(frames: np.ndarray | View) -> View:
    return frames if isinstance(frames, View) else View(frames)


def _plain(frames: np.ndarray | View) -> np.ndarray:
    return frames.frames if isinstance(frames, View) else frames


def card_split(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The widest inner gap between cards on two rows, if both have one, and the row's height; 0 and 0 else."""
    small = sampled(_view(frames))
    n, height, width = small.shape[:3]
    ratio, at = np.zeros(n), np.zeros(n)
    if width < 12 or height < 12:
        return ratio, at
    left = int(width * 0.05)
    right = max(left + 1, int(width * 0.95))
    hits = np.zeros(n, np.int64)
    for y in SPLIT_ROWS:
        content = small.has(_BIT["card"], np.s_[:, max(0, min(height - 1, round(y * (height - 1)))), left:right])
        row, start, end = runs(~content)
        inner = (start > 0) & (end < right - left)
        gap = np.zeros(n, np.int64)
        np.maximum.at(gap, row[inner], (end - start)[inner])
        gap = np.where(content.mean(1) >= 0.55, gap / (right - left), 0.0)
        hits += gap >= 0.04
        better = gap > ratio
        ratio, at = np.where(better, gap, ratio), np.where(better, y, at)
    return np.where(hits >= 2, ratio, 0.0), np.where(hits >= 2, at, 0.0)


# Value bars


def _segments(track: np.ndarray, first: int, width: int) -> list[tuple[int, int]]:
    """Three parts of a bar's best row, as start and end (exclusive): those that gaps set apart, or thirds. track: the row from the left margin on; first, width: its run."""
    _, start, end = runs(track[None])
    near = max(1, int(width * 0.005))
    joined: list[list[int]] = []
    for s, e in zip(start.tolist(), end.tolist()):
        if joined and s - joined[-1][1] <= near:
            joined[-1][1] = e
        else:
            joined.append([s, e])
    wide = [(s, e) for s, e in joined if e - s >= max(24, int(width * 0.08))]
    chosen: list[tuple[int, int]] = []
    for s, e in wide:
        if not chosen and s > first + max(24, int(width * 0.12)):
            continue
        if chosen and s - chosen[-1][1] > max(14, int(width * 0.06)):
            break
        chosen.append((s, e))
        if len(chosen) == 3:
            return chosen
    if len(wide) == 1 and wide[0][1] - wide[0][0] >= width * 0.55:
        first, width = wide[0][0], wide[0][1] - wide[0][0]
    return [(first + round(width * i / 3), first + round(width * (i + 1) / 3)) for i in range(3)]


def _points(filled: float) -> int:
    return 5 if filled >= 0.90 else 0 if filled <= 0.08 else int(filled * 5 + 0.5)


def bar_values(panels: np.ndarray, window: tuple[float, float]) -> np.ndarray:
    """The value 0 to 15 of the bar within a window of heights of each panel; -1 where there is none."""
    n, height, width = panels.shape[:3]
    out = np.full(n, -1, np.int64)
    if width < 20 or height < 20 or not n:
        return out
    panels = _view(panels)
    top, left, right = int(height * window[0]), int(width * 0.04), int(width * 0.96)
    bottom = max(top + 1, int(height * window[1]))
    here = np.s_[:, top:bottom, left:right]
    lines, filling = panels.has(_BIT["track"], here), panels.has(_BIT["fill"], here)
    count = lines.sum(2)
    first = np.where(count > 0, lines.argmax(2), 0)
    last = np.where(count > 0, lines.shape[2] - lines[..., ::-1].argmax(2), 0)
    best = (last - first + count).argmax(1)  # the first row whose span and pixels are most
    frame = np.arange(n)
    begin, span = first[frame, best], (last - first)[frame, best]
    middle = top + max(1, (bottom - top) // 2)
    label = share(panels.has(_BIT["fill"], np.s_[:, top:middle, int(width * 0.05) : int(width * 0.50)]))
    rows = np.arange(bottom - top)
    close = (np.abs(rows[None] - best[:, None]) <= 3)[..., None] & filling
    filled = close.any(1)
    for i in np.flatnonzero(span >= width * 0.35):
        own = filled[i].copy()
        own[: begin[i]] = own[begin[i] + span[i] :] = False
        if own.sum() / span[i] < 0.015 and label[i] < 0.030:
            continue
        out[i] = min(15, sum(_points(own[s:e].sum() / max(1, e - s)) for s, e in _segments(lines[i, best[i]], int(begin[i]), int(span[i])))) if own.any() else 0
    return out


def value_bars(panels: np.ndarray) -> dict[str, np.ndarray]:
    """The three values of each panel, read in the upper layout where a wide track shows near its top, else in the lower one."""
    n, height, width = panels.shape[:3]
    panels, top = _view(panels), int(height * 0.02)
    track = panels.has(_BIT["track"], np.s_[:, top : max(top + 1, int(height * 0.20)), int(width * 0.04) : int(width * 0.96)])
    upper = track.sum(2).max(1, initial=0) >= int(width * 0.45)
    out = {k: np.full(n, -1, np.int64) for k in UPPER_BARS}
    for rows, layout in ((np.flatnonzero(upper), UPPER_BARS), (np.flatnonzero(~upper), LOWER_BARS)):
        some = panels.taken(rows) if len(rows) < n else panels
        for k in out if len(rows) else ():
            out[k][rows] = bar_values(some, layout[k])
    return out


def stars(badges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many stars a badge shows, 4 for red ones, and whether any show; -1 if none do."""
    n, badges = len(badges), _view(badges)
    seen, reds, ambers, going = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for zone in STARS:
        part = cut(badges, zone)
        amber, red, edge = hues(part, ORANGE), sum(hues(part, band) for band in REDS), edges(part)
        grey = share(sampled(part, 80, 80).has(_BIT["pale"]))
        seen |= (amber >= 0.025) | (red >= 0.025) | (edge >= 0.045) | ((grey >= 0.060) & (edge >= 0.055))
        reds += (red >= 0.08) & (grey < 0.08)
        going &= (amber >= 0.24) & (red < 0.08) & (grey < 0.08)
        ambers += going
    return np.where(reds >= 2, 4, np.where(seen, ambers, -1)), seen | (reds >= 2)


# The tab of moves


def tab_anchors(frames: np.ndarray, bar_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The height of the tab's underline below a bar of hit points (NaN: none), and its score: the longest dark run of a row and a third of its dark share, from 0.12 of a run on. The first row at 0.70 counts, else the best at 0.45 or more."""
    n, height, width = frames.shape[:3]
    y, score = np.full(n, np.nan), np.zeros(n)
    if width < 20 or height < 20:
        return y, score
    here, frames = np.s_[:, :, int(width * 0.18) : int(width * 0.54)], _view(frames)
    dark_pixels, dim = frames.has(_BIT["dark"], here), frames.has(_BIT["dim"], here)
    row, start, end = runs(dark_pixels.reshape(n * height, -1))
    longest = np.zeros(n * height, np.int64)
    np.maximum.at(longest, row, end - start)
    size = max(1, dim.shape[2])
    run = longest.reshape(n, height) / size
    scores = np.where(run >= 0.12, run + _row_shares(dim) * 0.35, 0.0)
    rows = np.arange(height)
    known = ~np.isnan(bar_y)
    lower = np.where(known, bar_y, 0.0)
    first = np.maximum(0, (height * (lower + 0.20)).astype(np.int64))
    last = np.minimum(height, (height * np.minimum(0.98, lower + 0.78)).astype(np.int64))
    scores = np.where((rows >= first[:, None]) & (rows < last[:, None]) & known[:, None], scores, 0.0)
    sure = scores >= 0.70
    at = np.where(sure.any(1), sure.argmax(1), scores.argmax(1))
    score = scores[np.arange(n), at]
    return np.where(score >= 0.45, at / height, np.nan), score


# Change between frames


def motion_samples(frames: np.ndarray) -> np.ndarray:
    """A small grey picture of each frame, 40 rows of 120, as vectors."""
    return resized(luma(cut(frames, REGIONS["sequence_motion"])), 120, 40).reshape(len(frames), -1)


# All signals


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.array([round(v, 4) for v in x.tolist()])


_BAR = ("hp_bar_anchor_score", "hp_bar_anchor_y", "hp_bar_anchor_visible", "hp_bar_anchor_candidate_count")
_TAB = ("moves_tab_anchor_score", "moves_tab_anchor_y", "moves_tab_anchor_visible", "moves_visual_region_anchored")
_SPLIT = ("hp_area_card_gap_ratio", "hp_area_card_gap_y")
_BY_TAB = (*[f"{k}_dark_ratio" for k in MOVES_BY_TAB if k not in ("moves_tabs", "moves_new_attack_button")], "moves_tab_dark_ratio", "moves_tab_edge_ratio", "moves_new_attack_button_green_ratio", "moves_completion_footer_height", "moves_new_attack_button_height")
_VALUES = ("iv_attack", "iv_defense", "iv_stamina", "iv_bar_count", "iv_star_count", "iv_panel_visible", "iv_seal_visible")
#: What some signals are told from.
_NEEDS = {"hp_area_card_split_signal": ("hp_area_card_gap_ratio", "horizontal_card_gap_ratio"), **dict.fromkeys(_VALUES, ("iv_panel_light_ratio", "iv_seal_color_ratio")), **dict.fromkeys(_BY_TAB, _TAB)}


def signals(frames: np.ndarray, only: Collection[str] | None = None) -> dict[str, np.ndarray]:
    """What the rules over signals read, of each frame. Anchors that are not there are NaN, values that are not there -1. only: the names wanted; what none of them needs is left out."""
    view = View(frames)
    region = cache(lambda k: cut(view, REGIONS[k]))
    plain = {
        "list_text_dark_ratio": lambda: dark(region("list_rows"), 90),
        "list_pokemon_art_signal": lambda: hues(region("list_rows"), COLOURED),
        "detail_card_brightness": lambda: brightness(region("detail_card")),
        "hp_green_ratio": lambda: hues(region("hp"), GREEN),
        "name_dark_ratio": lambda: dark(region("name"), 185),
        "moves_dark_ratio": lambda: dark(region("moves"), 185),
        "story_brightness": lambda: brightness(region("story")),
        "story_dark_ratio": lambda: dark(region("story"), 205),
        "orange_badge_ratio": lambda: hues(region("appraisal_badge"), ORANGE),
        "pokemon_art_signal": lambda: edges(region("pokemon_art")) + saturated(region("pokemon_art")) * 0.25,
        "horizontal_card_gap_ratio": lambda: dim_columns(region("horizontal_swipe_card")),
        "iv_panel_light_ratio": lambda: light(region("iv_panel"), 245),
        "iv_seal_color_ratio": lambda: hues(region("appraisal_badge"), ORANGE) + sum(hues(region("appraisal_badge"), band) for band in REDS),
        "hp_region_dark_ratio": lambda: dark(region("hp"), 185),
        "hp_bar_edge_ratio": lambda: edges(region("hp_bar")),
        "hp_text_edge_ratio": lambda: edges(region("hp_text")),
        "hp_bar_saturation_ratio": lambda: hues(region("hp_bar"), BAR_COLOURED),
        "hp_bar_orange_ratio": lambda: hues(region("hp_bar"), BAR_ORANGE),
    }
    every = {*plain, *_SPLIT, "hp_area_card_split_signal", *_BAR, *_TAB, "tag_edge_ratio", *_BY_TAB, *_VALUES, "list_bright_row_bands"}
    wanted = every if only is None else set(only)
    if wanted - every:
        raise ValueError(f"no signals: {', '.join(sorted(wanted - every))}")
    needed = wanted | {n for k in wanted for n in _NEEDS.get(k, ())}
    out = {k: make() for k, make in plain.items() if k in needed}
    if needed & {*_SPLIT}:
        out |= zip(_SPLIT, card_split(view))
    by_tab = bool(needed & {*_TAB})
    whole: dict[str, np.ndarray] = {}
    if by_tab or needed & {*_BAR, "tag_edge_ratio"}:
        bars = bar_anchors(view)
        tab_y, tab_score = tab_anchors(view, _rounded(bars["anchor_y"])) if by_tab else (None, None)
        out |= {"hp_bar_anchor_score": bars["anchor_score"]}
        whole |= {"hp_bar_anchor_y": _rounded(np.nan_to_num(bars["anchor_y"])), "hp_bar_anchor_visible": ~np.isnan(bars["anchor_y"]), "hp_bar_anchor_candidate_count": bars["anchors"]}
        if by_tab:
            out |= {"moves_tab_anchor_score": tab_score}
            whole |= {"moves_tab_anchor_y": _rounded(np.nan_to_num(tab_y)), "moves_tab_anchor_visible": ~np.isnan(tab_y), "moves_visual_region_anchored": ~np.isnan(tab_y)}
        out |= _anchored(view, bars["anchor_y"], tab_y, needed)
    out = {k: _rounded(v) for k, v in out.items()} | whole
    if "list_bright_row_bands" in needed:
        out["list_bright_row_bands"] = bright_bands(region("list_rows"))
    if "hp_area_card_split_signal" in needed:
        out["hp_area_card_split_signal"] = (out["hp_area_card_gap_ratio"] >= 0.04) & (out["horizontal_card_gap_ratio"] >= 0.05)
    if needed & {*_VALUES}:
        out |= _appraisal(out, region("appraisal_badge"), region("iv_panel"))
    return out if only is None else {k: out[k] for k in only}


def _appraisal(out: dict[str, np.ndarray], badge: View, panel: View) -> dict[str, np.ndarray]:
    """Bars and stars, where a panel and a seal show; only such frames are looked at closer."""
    n = len(badge)
    panel_visible = (out["iv_panel_light_ratio"] >= 0.30) & (edges(panel) >= 0.08)
    rows = np.flatnonzero(panel_visible & (out["iv_seal_color_ratio"] >= 0.05))
    found = {k: np.full(n, -1, np.int64) for k in (*UPPER_BARS, "iv_star_count")}
    seal = np.zeros(n, bool)
    if len(rows):
        count, shown = stars(badge.taken(rows))
        rows, count = rows[shown], count[shown]
        seal[rows], found["iv_star_count"][rows] = True, count
    if len(rows):
        for k, v in value_bars(panel.taken(rows)).items():
            found[k][rows] = v
    return found | {"iv_bar_count": sum((found[k] >= 0).astype(np.int64) for k in UPPER_BARS), "iv_panel_visible": panel_visible, "iv_seal_visible": seal}


def _box(left: float, top: float, right: float, bottom: float) -> tuple[float, float, float, float]:
    upper = max(0.0, min(0.98, top))
    return max(0.0, left), upper, min(1.0, right), max(upper + 0.01, min(1.0, bottom))


def _anchored(view: View, bar_y: np.ndarray, tab_y: np.ndarray | None, needed: Collection[str]) -> dict[str, np.ndarray]:
    """Signals of regions whose place depends on an anchor: frames with equal anchors go together."""
    n = len(view)
    out = {k: np.zeros(n) for k in ("tag_edge_ratio", *_BY_TAB) if k in needed}
    for y in np.unique(bar_y) if "tag_edge_ratio" in out else ():
        mine = np.flatnonzero(np.isnan(bar_y) if np.isnan(y) else bar_y == y)
        box = REGIONS["tag"] if np.isnan(y) else _box(0.06, y + 0.035, 0.94, y + 0.145)
        out["tag_edge_ratio"][mine] = edges(cut(view, box).taken(mine))
    for y in np.unique(tab_y) if len(out.keys() & {*_BY_TAB}) else ():
        mine = np.flatnonzero(np.isnan(tab_y) if np.isnan(y) else tab_y == y)
        box = {k: REGIONS[k] if np.isnan(y) else _box(left, y + top, right, y + bottom) for k, (left, top, bottom, right) in MOVES_BY_TAB.items()}
        part = cache(lambda k: cut(view, box[k]).taken(mine))  # noqa: B023
        for name in _BY_TAB:
            if name not in out:
                continue
            if name == "moves_tab_dark_ratio":
                out[name][mine] = dark(part("moves_tabs"), 185)
            elif name == "moves_tab_edge_ratio":
                out[name][mine] = edges(part("moves_tabs"))
            elif name == "moves_new_attack_button_green_ratio":
                out[name][mine] = hues(part("moves_new_attack_button"), GREEN)
            elif name.endswith("_height"):
                region = box[name.removesuffix("_height")]
                out[name][mine] = max(0.0, region[3] - region[1])
            else:
                region = name.removesuffix("_dark_ratio")
                out[name][mine] = dark(part(region), 90 if region == "moves_transition_guard" else 185)
    return out
