"""Sequential association of detections to persistent targets: order decides, so each survey is folded in frame order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from deepledger.functions import constants as K

SIGNALS = ("class", "geographic", "frame", "spatial")
DECISION = "survey_id long, detection_id string, target_id string, decision string, score double, " + ", ".join(f"{k}_score double" for k in SIGNALS)
FIELDS = ["survey_id", "image_id", "frame_index", "detection_id", "class_name", "lat", "lon", "x", "y", "w", "h"]
STATE = "target_id string, class_name string, lat double, lon double, box_id string, x double, y double, w double, h double, last_frame double"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_OUT = [c.split()[0] for c in DECISION.split(", ")]


def new_id(survey: object, detection: object) -> str:
    """Content-derived id of the target that a detection founds, so that a second run gives the same ids."""
    return "tgt_" + hashlib.sha256(f"{survey}|{detection}".encode()).hexdigest()[:12]


def _ramp(x: np.ndarray, full: float, none: float) -> np.ndarray:
    return np.clip((none - x) / (none - full), 0.0, 1.0)


def _scores(values: np.ndarray, own: Sequence, same: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The scores of targets, values in the order of Fold.NUMBERS, for detections of numbers own, and their four signals, nan where not available."""
    lat, lon, x, y, w, h, last = values
    own_lat, own_lon, own_x, own_y, own_w, own_h, own_frame = own
    rad = np.pi / 180
    a = np.sin((lat - own_lat) * (rad / 2)) ** 2 + np.cos(own_lat * rad) * np.cos(lat * rad) * np.sin((lon - own_lon) * (rad / 2)) ** 2
    distance = 2 * K.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))
    gap = np.abs(last - own_frame)
    wide = np.minimum(x + w, own_x + own_w) - np.maximum(x, own_x)
    tall = np.minimum(y + h, own_y + own_h) - np.maximum(y, own_y)
    inner = np.maximum(0, wide) * np.maximum(0, tall)
    union = w * h + own_w * own_h - inner
    overlap = np.where(union > 0, inner / np.where(union > 0, union, 1), np.where(np.isnan(union), np.nan, 0.0))
    signals = [np.broadcast_to(same.astype(float), lat.shape), _ramp(distance, *K.DISTANCE_RAMP), _ramp(gap, *K.FRAME_RAMP), _ramp(1 - overlap, *K.OVERLAP_RAMP)]
    total, used = np.zeros(lat.shape), np.zeros(lat.shape)
    for value, weight in zip(signals, K.ASSOCIATION_WEIGHTS.values()):
        there = value == value
        total += np.where(there, value, 0.0) * weight
        used += there * weight
    score = total / used * np.where(same, 1.0, K.CLASS_PENALTY)
    score *= np.where(np.round(distance, 1) > K.DISTANCE_RAMP[1], K.GEO_PENALTY, 1.0)
    apart = (np.round(overlap, 3) <= 0) & (gap <= 1)
    return np.round(score * np.where(apart, K.SPATIAL_PENALTY, 1.0), 4), signals


def _moved(values: np.ndarray, box_ids: list[str] | np.ndarray, i: int, detection: str, numbers: tuple[float, ...]) -> None:
    """Target i takes the place of a detection that it accepts, its box if the id is smaller, and the later frame."""
    if numbers[0] == numbers[0]:
        values[:2, i] = numbers[:2]
    if detection < box_ids[i]:
        box_ids[i] = detection
        values[2:6, i] = numbers[2:6]
    values[6, i] = np.fmax(values[6, i], numbers[6])


class Fold:
    """Live targets of one survey as growing arrays; each detection is scored against all of them at once.

    Null frame index, position or box make a signal unavailable. An accepted detection with a position overwrites its target's.
    A target's box is that of its linked detection with the smallest id. Ties of score go to the smaller target id.
    """

    NUMBERS = ("lat", "lon", "x", "y", "w", "h", "last_frame")

    def __init__(self, targets: pd.DataFrame | None = None):
        self.ids: list[str] = []
        self.box_ids: list[str] = []
        self.codes: dict[str, int] = {}
        self.class_of = np.zeros(16, np.int64)
        self.values = np.full((len(self.NUMBERS), 16), np.nan)
        for row in targets[_NAMES].itertuples(index=False) if targets is not None else ():
            self.add(row.target_id, row.class_name, row.box_id, [getattr(row, c) for c in self.NUMBERS])

    def add(self, target: str, name: str, box_id: str, numbers: list[float]) -> None:
        n = len(self.ids)
        if n == len(self.class_of):
            self.class_of, self.values = np.concatenate([self.class_of, self.class_of]), np.concatenate([self.values, self.values], axis=1)
        self.ids.append(target)
        self.box_ids.append(box_id)
        self.class_of[n] = self.codes.setdefault(name, len(self.codes))
        self.values[:, n] = numbers

    def frame(self) -> pd.DataFrame:
        n, names = len(self.ids), {v: k for k, v in self.codes.items()}
        numbers = dict(zip(self.NUMBERS, self.values[:, :n]))
        return pd.DataFrame({"target_id": self.ids, "class_name": [names[c] for c in self.class_of[:n]], "box_id": self.box_ids, **numbers})[_NAMES]

    def scores(self, name: str, numbers: tuple[float, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The score of each live target, and its four signals, null (nan) where not available."""
        n = len(self.ids)
        return _scores(self.values[:, :n], numbers, self.class_of[:n] == self.codes.get(name, -1))

    def take(self, survey: object, detection: str, name: str, numbers: tuple[float, ...], linked: str | None = None) -> tuple:
        """(target, decision, score, signals) of one detection, which may found a target. One that is linked already keeps its target."""
        none = (None,) * len(SIGNALS)
        if linked is not None:
            return linked, "reused", None, *none
        score, signals = None, none
        if self.ids:
            scores, each = self.scores(name, numbers)
            score = float(scores.max())
            top = np.flatnonzero(scores == score)
            best = int(top[0]) if len(top) == 1 else min(top.tolist(), key=self.ids.__getitem__)
            signals = tuple(round(float(v[best]), 3) if v[best] == v[best] else None for v in each)
            if score >= K.ACCEPT:
                second = score if len(top) > 1 else float(np.delete(scores, best).max()) if len(scores) > 1 else -1.0
                if round(score - second, 4) < K.AMBIGUITY:
                    return None, "ambiguous", score, *signals
                _moved(self.values, self.box_ids, best, detection, numbers)
                return self.ids[best], "accepted", score, *signals
        target = new_id(survey, detection)
        self.add(target, name, detection, list(numbers))
        return target, "new_target", score, *signals

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The decisions of one survey's rows, whatever their order."""
        rows = rows.assign(_o=rows["frame_index"].fillna(1e9)).sort_values(["_o", "image_id", "detection_id"])
        return pd.DataFrame([(r[0], r[1], *self.take(*r)) for r in _records(rows)], columns=_OUT)


def _records(rows: pd.DataFrame) -> Iterator[tuple]:
    """(survey, detection, class, numbers in the order of Fold.NUMBERS, linked target) of each row."""
    numbers = rows[["lat", "lon", "x", "y", "w", "h", "frame_index"]].astype(float).itertuples(index=False, name=None)
    links = [None if pd.isna(t) else t for t in rows["target_id"]] if "target_id" in rows else [None] * len(rows)
    return zip(rows["survey_id"], rows["detection_id"], rows["class_name"], numbers, links)


#: Rows up to which a survey is held until it is whole, to be folded beside others.
WHOLE = 5_000
#: Places of targets, used or not, that surveys folded side by side may take.
CELLS = 1 << 20
#: What a target of another class can score at most.
_OTHERS = K.CLASS_PENALTY * (1 - K.ASSOCIATION_WEIGHTS["class"] / sum(K.ASSOCIATION_WEIGHTS.values())) + 1e-4


def _surveys(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The survey of each row as text, and the first row of each survey."""
    names = rows["_survey"].fillna("").to_numpy(object)
    return names, np.flatnonzero(np.r_[True, names[1:] != names[:-1]])


def _number(name: str | None) -> object:
    """The survey in the id of a target."""
    return int(name) if name else np.nan


def one_by_one(fold: Fold, rows: pd.DataFrame) -> list[tuple]:
    """The decisions of ordered rows of one survey, of which those of _kind 0 are known targets."""
    out = []
    for name, kind, (number, detection, label, numbers, link) in zip(rows["_survey"], rows["_kind"], _records(rows)):
        if kind:
            out.append((number, detection, *fold.take(_number(None if pd.isna(name) else name), detection, label, numbers, link)))
        else:
            fold.add(link, label, detection or "", list(numbers))
    return out


def side_by_side(rows: pd.DataFrame) -> list[tuple]:
    """The decisions of whole surveys, rows as of one_by_one: each step takes the next detection of every survey.

    Targets lie by survey and class. A detection is scored against those of its own class; only if none of these beats what another
    class can score at most, against the others of its survey.
    """
    names, starts = _surveys(rows)
    lane = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
    labels, classes = pd.factorize(rows["class_name"], use_na_sentinel=False)
    keys, bins, sizes = np.unique(lane * len(classes) + labels, return_inverse=True, return_counts=True)
    if len(keys) * int(sizes.max()) > CELLS:
        return [r for i, j in zip(starts, np.r_[starts[1:], len(rows)]) for r in one_by_one(Fold(), rows[i:j])]
    edges = np.searchsorted(keys // len(classes), np.arange(len(starts) + 1))  # the bins of each survey
    values = np.full((len(Fold.NUMBERS), len(keys), int(sizes.max())), np.nan)
    ids, boxes = np.empty(values.shape[1:], object), np.empty(values.shape[1:], object)
    n = np.zeros(len(keys), np.int64)
    records, kinds, out, order = list(_records(rows)), rows["_kind"].to_numpy(), [], []
    own = np.array([r[3] for r in records])
    none = (None,) * len(SIGNALS)

    def add(b: int, target: str, box: str, numbers: tuple[float, ...]) -> None:
        ids[b, n[b]], boxes[b, n[b]], values[:, b, n[b]] = target, box, numbers
        n[b] += 1

    for i, (survey, detection, _, numbers, link) in enumerate(records):
        if not kinds[i]:
            add(bins[i], link, detection or "", numbers)
        elif link is not None:
            out.append((survey, detection, link, "reused", None, *none))
        else:
            order.append(i)
    order = np.array(order, np.int64)
    turn = np.arange(len(order)) - np.searchsorted(lane[order], lane[order])
    order = order[np.argsort(turn, kind="stable")]
    for step in np.split(order, np.cumsum(np.bincount(turn))[:-1]) if len(order) else ():
        at = bins[step]
        width = max(1, int(n[at].max()))
        scores, each = _scores(values[:, at, :width], own[step].T[:, :, None], np.True_)
        scores[np.arange(width) >= n[at][:, None]] = -1.0
        top, place = scores.max(axis=1), scores.argmax(axis=1)
        ties = (scores == top[:, None]).sum(axis=1)
        found = np.stack([v[np.arange(len(step)), place] for v in each], axis=1).tolist()
        rest = scores.copy()
        rest[np.arange(len(step)), place] = -1.0
        second = np.where(ties > 1, top, rest.max(axis=1))
        weak: dict[int, tuple[float, tuple]] = {}
        pairs = [(j, b) for j in np.flatnonzero(top <= _OTHERS) for b in range(edges[lane[step[j]]], edges[lane[step[j]] + 1]) if b != at[j] and n[b]]
        if pairs:
            of, other = (np.array(x) for x in zip(*pairs))
            wide = int(n[other].max())
            far, there = _scores(values[:, other, :wide], own[step[of]].T[:, :, None], np.False_)
            far[np.arange(wide) >= n[other][:, None]] = -1.0
            for p, score in enumerate(far.max(axis=1).tolist()):
                j, b = int(of[p]), int(other[p])
                for q in np.flatnonzero(far[p] == score).tolist():
                    if (held := weak.get(j)) is None or (-score, ids[b, q]) < held[:2]:
                        weak[j] = (-score, ids[b, q], [float(v[p, q]) for v in there])
        for j, i in enumerate(step.tolist()):
            survey, detection, _, numbers, _ = records[i]
            b, best, score, seen = int(at[j]), int(place[j]), float(top[j]), found[j]
            if score >= 0 and ties[j] > 1:
                best = min(np.flatnonzero(scores[j] == score).tolist(), key=lambda q: ids[b, q])
                seen = [float(v[j, best]) for v in each]
            if (other_best := weak.get(j)) is not None and (score < 0 or other_best[:2] < (-score, ids[b, best])):
                score, seen = -other_best[0], other_best[2]
            signals = tuple(round(v, 3) if v == v else None for v in seen) if score >= 0 else none
            if score < K.ACCEPT:
                target = new_id(_number(names[i]), detection)
                add(b, target, detection, numbers)
                out.append((survey, detection, target, "new_target", score if score >= 0 else None, *signals))
            elif round(score - float(second[j]), 4) < K.AMBIGUITY:
                out.append((survey, detection, None, "ambiguous", score, *signals))
            else:
                _moved(values[:, b], boxes[b], best, detection, numbers)
                out.append((survey, detection, ids[b, best], "accepted", score, *signals))
    return out


def known_targets(detections: DataFrame, targets: DataFrame) -> DataFrame:
    """The state of each of targets (survey_id, target_id, class_name, lat, lon) by the detections linked to it: the box of the smallest id, the last frame."""
    box = F.min_by(F.struct("detection_id", "x", "y", "w", "h"), "detection_id").alias("box")
    linked = detections.where("target_id is not null").groupBy("survey_id", "target_id").agg(box, F.max("frame_index").alias("last_frame"))
    rows = targets.select("survey_id", "target_id", "class_name", "lat", "lon").join(linked, ["survey_id", "target_id"], "left")
    return rows.select("survey_id", "target_id", "class_name", "lat", "lon", F.col("box.detection_id").alias("detection_id"), *[F.col(f"box.{c}").alias(c) for c in "xywh"], F.col("last_frame").alias("frame_index"))


def associate(detections: DataFrame, targets: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """(survey_id, detection_id, target_id, decision, score, signals of the best candidate) of all detections.

    targets: those of earlier runs; detections with a target_id are linked to them and reused, so that a second run changes nothing.
    Without the argument, and the column, everything is decided anew. frames: (survey_id, width, height); boxes count only in surveys
    whose frames are all of one size. Null survey: a survey of its own. No rows: no rows.

    A survey is folded in one task, since each decision depends on those before it; its rows stream through in order. Surveys of up
    to WHOLE rows are held whole and folded side by side, a longer one by itself, so that the task holds a batch of rows, WHOLE more
    and the live targets.
    """
    linked = F.col("target_id") if "target_id" in detections.columns else F.lit(None).cast("string")
    rows = detections.select(*FIELDS, linked.alias("target_id"), F.lit(1).alias("_kind"))
    if targets is not None:
        state = known_targets(rows, targets).withColumns({"image_id": F.lit(None).cast(rows.schema["image_id"].dataType), "_kind": F.lit(0)})
        rows = rows.unionByName(state.select(*rows.columns))
    if frames is not None:
        mixed = frames.groupBy("survey_id").agg(F.count_distinct(F.struct("width", "height")).alias("_sizes")).where("_sizes > 1")
        rows = rows.join(mixed, "survey_id", "left").withColumns({c: F.when(F.col("_sizes").isNull(), F.col(c)) for c in "xywh"}).drop("_sizes")
    order = F.coalesce(F.nanvl(F.col("frame_index").cast("double"), F.lit(1e9)), F.lit(1e9))
    rows = rows.withColumns({"_survey": F.col("survey_id").cast("string"), "_o": F.when(F.col("_kind") == 1, order).otherwise(-1.0)}).repartition("survey_id")
    ordered = rows.sortWithinPartitions(F.asc_nulls_last("_survey"), "_kind", "_o", F.asc_nulls_last("image_id"), F.asc_nulls_last("detection_id"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, fold, long = None, None, None
        for batch in chain(batches, [None]):  # None: no more rows
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = None
            if rows is None or rows.empty:
                continue
            names, starts = _surveys(rows)
            first, last, out = 0, len(rows) if batch is None else int(starts[-1]), []
            if names[0] == long:
                first = int(starts[1]) if len(starts) > 1 else len(rows)
                out += one_by_one(fold, rows[:first])
            if first < last:
                out += side_by_side(rows[first:last])
            if batch is not None and first <= last:  # the last survey may go on
                held = rows[last:]
                if len(held) > WHOLE:
                    fold, long = Fold(), names[-1]
                    out += one_by_one(fold, held)
                    held = None
            yield pd.DataFrame(out, columns=_OUT)

    return ordered.mapInPandas(work, DECISION)


class FoldProcessor(StatefulProcessor):
    """The same fold over a stream: a survey's live targets are its state, and frames must arrive in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.targets = handle.getListState("targets", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = [tuple(r) for r in self.targets.get()] if self.targets.exists() else []
        fold = Fold(pd.DataFrame(known, columns=_NAMES) if known else None)
        out = fold.run(pd.concat(list(rows), ignore_index=True))
        self.targets.put([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in fold.frame().itertuples(index=False)])
        yield out

    def close(self) -> None:
        pass


def associate_stream(detections: DataFrame) -> DataFrame:
    """The decisions of `associate` for a streaming DataFrame, with state per survey. Needs the RocksDB state store."""
    return detections.select(*FIELDS).groupBy("survey_id").transformWithStateInPandas(FoldProcessor(), DECISION, "Append", "None")


def summary(decisions: DataFrame) -> DataFrame:
    """Counts of each survey's decisions."""
    return decisions.groupBy("survey_id").agg(
        F.count("*").alias("detections"), F.count_distinct("target_id").alias("targets"), F.count_if(F.col("decision") == "accepted").alias("accepted"),
        F.count_if(F.col("decision") == "ambiguous").alias("ambiguous"), F.count_if(F.col("decision") == "new_target").alias("founded"), F.count_if(F.col("decision") == "reused").alias("reused"),
    )
