"""Media rows: hashes, known-hash joins, detections, recognised text, limits and statuses."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelflow.operators import policy as P

# The detector's classes: label, least confidence, severity.
CLASSES = {
    "explicit_nudity": ("NSFW", 0.55, 3), "exposed_genitals": ("NSFW", 0.55, 3), "exposed_breast": ("NSFW", 0.60, 2), "exposed_buttocks": ("NSFW", 0.65, 2),
    "sexual_activity": ("NSFW", 0.50, 3), "adult_toy": ("NSFW", 0.65, 2), "casino_logo": ("SCAM", 0.65, 1), "slot_machine_ui": ("SCAM", 0.60, 2), "roulette": ("SCAM", 0.65, 2),
    "betting_coupon": ("SCAM", 0.65, 2), "gambling_banner": ("SCAM", 0.60, 2), "suspicious_qr": ("SCAM", 0.75, 1), "fake_giveaway_banner": ("SCAM", 0.60, 2),
}
# Limits of recognised text.
OCR_LINE, OCR_MEAN, OCR_LENGTH, OCR_LINES, OCR_TEXT = 0.45, 0.50, 3, 128, 8000


def iou(a: Column, b: Column) -> Column:
    """Of two structs x1, y1, x2, y2."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    both = area(a) + area(b) - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


def suppressed(boxes: Column, limit: float = 0.45, most: int = 100) -> Column:
    """Greedy suppression by class over array<struct<cls, confidence, x1, y1, x2, y2>>: from the most
    confident on, a box stays unless one of its class that stays overlaps it by more than limit."""
    order = F.array_sort(F.transform(boxes, lambda b: F.struct((-b["confidence"]).alias("c"), b.alias("b"))))
    kind = "array<struct<cls:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"

    def step(acc: Column, e: Column) -> Column:
        b = e["b"]
        clash = F.exists(acc, lambda k: (k["cls"] == b["cls"]) & (iou(k, b) > limit))
        return F.when(clash | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(order, F.array().cast(kind), step)


def decoded_boxes(cx: Column, cy: Column, w: Column, h: Column, scale: Column, pad_x: Column, pad_y: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners in the picture from a centre and size in the padded, scaled one."""
    at = lambda v, pad, top: F.least(F.greatest((v - pad) / scale, F.lit(0.0)), top.cast("double"))
    return {"x1": at(cx - w / 2, pad_x, width), "y1": at(cy - h / 2, pad_y, height), "x2": at(cx + w / 2, pad_x, width), "y2": at(cy + h / 2, pad_y, height)}


def detection_signals(detections: DataFrame, key: str, image_classes: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Signals from (key, pos, cls, confidence): by the detector's classes, else by a map of other classes
    with severity 4; classes in neither give none."""
    fallback = image_classes or {}
    label = F.coalesce(P.lookup({k: v[0] for k, v in CLASSES.items()}, F.col("cls")), P.lookup({k: v[0] for k, v in fallback.items()} or {"": ""}, F.lower("cls")))
    least = F.coalesce(P.lookup({k: v[1] for k, v in CLASSES.items()}, F.col("cls")), P.lookup({k: v[1] for k, v in fallback.items()} or {"": 1.0}, F.lower("cls")))
    severity = F.coalesce(P.lookup({k: v[2] for k, v in CLASSES.items()}, F.col("cls")), F.lit(4))
    x = detections.withColumn("label", label).withColumn("severity", severity).where(F.col("label").isNotNull() & (F.col("confidence") >= least))
    return x.select(key, "pos", F.lit("IMAGE").alias("source"), "label", "confidence", "severity", P.lookup(P.LABEL_WEIGHTS, F.col("label"), 0).cast("double").alias("risk_weight"), F.concat(F.lit("image."), "cls").alias("rule_id"))


def ocr_text(lines: Column) -> Column:
    """struct<text, mean> of array<struct<text, confidence>>; null where the lines are too unsure or short."""
    kept = F.slice(F.filter(lines, lambda x: x["confidence"] >= OCR_LINE), 1, OCR_LINES)
    text = F.substring(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), 1, OCR_TEXT)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(kept)
    ok = (F.size(kept) > 0) & (mean >= OCR_MEAN) & (F.length(F.trim(text)) >= OCR_LENGTH)
    return F.when(ok, F.struct(text.alias("text"), F.round(mean, 6).alias("mean")))


def pack_bits(bits: Column) -> Column:
    """64 booleans as a long, the first highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def hamming_join(rows: DataFrame, key: str, h: str, known: DataFrame, known_key: str, known_h: str, most: int = 6) -> DataFrame:
    """(key, known_key, distance) of hashes at most so many bits apart. Hashes are cut into most + 1 bands,
    and two that near agree in one band at least, so candidates come from a join by equality of bands;
    each pair is kept in its first common band only."""
    n = most + 1
    edges = [round(i * 64 / n) for i in range(n + 1)]
    band = lambda c, i: F.expr(f"shiftrightunsigned({c}, {edges[i]})").bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    banded = lambda df, k, c, a: df.select(F.col(k).alias(a), F.col(c).alias(f"{a}_h"), F.posexplode(F.array(*[band(c, i) for i in range(n)])).alias("band", "part"))
    x = banded(rows, key, h, "l").join(banded(known, known_key, known_h, "r"), ["band", "part"])
    apart = F.col("l_h").bitwiseXOR(F.col("r_h"))
    first = F.least(*[F.when(F.expr(f"shiftrightunsigned(l_h ^ r_h, {edges[i]})").bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) == 0, i) for i in range(n)])
    x = x.withColumn("distance", F.bit_count(apart)).where((F.col("distance") <= most) & (first == F.col("band")))
    return x.select(F.col("l").alias(key), F.col("r").alias(known_key), "distance")


def limits(attachments: DataFrame, request: str, most: int, size: int, total: int, width: int, height: int, pixels: int) -> DataFrame:
    """Adds error, the first limit that an attachment breaks, or null. count and total are by request."""
    from pyspark.sql import Window

    w = Window.partitionBy(request)
    return attachments.withColumn("error", F.when(F.count("*").over(w) > most, "too_many").when(F.col("size") > size, "too_large")
        .when(F.sum("size").over(w) > total, "total_too_large").when((F.col("width") > width) | (F.col("height") > height) | (F.col("width") * F.col("height") > pixels), "too_many_pixels"))


# Which errors are the sender's fault.
REJECTIONS = ("invalid_type", "too_many", "too_large", "total_too_large", "too_many_pixels", "unsafe_url", "decode_failed")


def status(error: Column, duplicate: Column) -> Column:
    return F.when(error.isin(*REJECTIONS), "rejected").when(error.isNotNull(), "unavailable").when(duplicate, "duplicate").otherwise("analyzed")


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes().hex()


def _cosines(n: int = 32) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis


_HASHES = T.StructType([T.StructField(c, T.StringType()) for c in ("ahash", "dhash", "phash")])


@F.pandas_udf(_HASHES)
def picture_hashes(luma: pd.Series) -> pd.DataFrame:
    """Average, gradient and cosine hashes of 32 x 32 grey bytes, 64 bits each, the first highest; null for
    other sizes. Hashes of gradients use the top left 8 x 9 pixels, of cosines the 8 x 8 lowest
    frequencies against their median without the constant one."""
    basis = _cosines()
    out = []
    for raw in luma:
        if raw is None or len(raw) != 1024:
            out.append((None, None, None))
            continue
        p = np.frombuffer(raw, dtype=np.uint8).reshape(32, 32).astype(np.float64)
        cells = p.reshape(8, 4, 8, 4).mean(axis=(1, 3))
        low = (basis @ p @ basis.T)[:8, :8]
        out.append((_hex(cells >= cells.mean()), _hex(p[:8, 1:9] >= p[:8, :8]), _hex(low >= np.median(low.ravel()[1:]))))
    return pd.DataFrame(out, columns=["ahash", "dhash", "phash"])


def attachment_errors(requests: DataFrame, attachments: DataFrame, key: str, attachment: str, declared: str, flag: str) -> DataFrame:
    """(key, errors) of requests: attachment ids must differ, the flag be set and the declared number be right."""
    ids = attachments.groupBy(key, attachment).agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("n_ids"))
    x = requests.join(ids, key, "left").fillna(0, ["n", "n_ids"])
    errors = F.array_compact(F.array(
        F.when(F.col("n_ids") < F.col("n"), F.lit("duplicate_attachment_id")), F.when(~F.col(flag), F.lit("flag_not_set")), F.when(F.col(declared) != F.col("n"), F.lit("count_mismatch"))
    ))
    return x.select(key, errors.alias("errors"))


def attachments_of(events: DataFrame, attachments: DataFrame, key: str, only: Column | None = None) -> DataFrame:
    """Attachments with their events; only: which attachments."""
    return events.join(attachments if only is None else attachments.where(only), key)


def labels_by_attachment(signals: DataFrame, attachment: str, order: str) -> DataFrame:
    """(attachment, labels): each label once, in the order of its first signal."""
    first = signals.groupBy(attachment, "label").agg(F.min(order).alias("_o"))
    labels = F.transform(F.sort_array(F.collect_list(F.struct("_o", "label"))), lambda x: x["label"])
    return first.groupBy(attachment).agg(labels.alias("labels"))


def warnings(*lists: Column, most: int = 8) -> Column:
    """Warnings of the text and of its attachments, each once, in order, the first so many."""
    return F.slice(F.array_distinct(F.concat(*lists)), 1, most)


def best_class(scores: Column, names: list[str], objectness: Column | None = None) -> Column:
    """struct<cls, confidence>: the class of the greatest score, the first of equal ones, times the objectness."""
    top = F.array_max(scores)
    confidence = top if objectness is None else top * objectness
    return F.struct(F.get(F.array(*map(F.lit, names)), (F.array_position(scores, top) - 1).cast("int")).alias("cls"), confidence.alias("confidence"))


def known_matches(rows: DataFrame, key: str, sha256: str, registry: DataFrame, phash: str | None = None, most: int = 6) -> DataFrame:
    """(key, kind): sha256 where the registry (sha256, phash) has the row's digest, else phash where it has a hash at
    most so many bits away. phash columns are longs."""
    exact = rows.join(registry.select(F.col("sha256").alias(sha256)).where(F.col(sha256).isNotNull()).distinct(), sha256, "left_semi").select(key, F.lit("sha256").alias("kind"))
    if phash is None:
        return exact
    known = registry.where("phash is not null").select(F.monotonically_increasing_id().alias("_id"), F.col("phash").alias("_h"))
    near = hamming_join(rows.where(F.col(phash).isNotNull()), key, phash, known, "_id", "_h", most).select(key).distinct()
    return exact.unionByName(near.join(exact, key, "left_anti").select(key, F.lit("phash").alias("kind")))


def known_signals(matches: DataFrame, key: str) -> DataFrame:
    """Signals of known pictures: a scam for sure."""
    return matches.select(key, F.lit(0).alias("pos"), F.lit("IMAGE").alias("source"), F.lit("SCAM").alias("label"), F.lit(1.0).alias("confidence"), F.lit(4).alias("severity"), F.lit(float(P.LABEL_WEIGHTS["SCAM"])).alias("risk_weight"), F.concat(F.lit("image.known_"), "kind").alias("rule_id"))


def ocr_signals(rule_signals: DataFrame, scores: DataFrame, ocr: DataFrame, key: str) -> DataFrame:
    """Signals of recognised text: those of the rules as they are, those of the classifier no surer than the
    recognition (key, ocr_confidence); SAFE is none."""
    cols = [c for c in rule_signals.columns if c != "source"]
    least = F.least("confidence", F.coalesce("ocr_confidence", "confidence"))
    seen = scores.where("label <> 'SAFE'").join(ocr.select(key, "ocr_confidence"), key)
    seen = seen.withColumn("confidence", least).withColumn("rule_id", F.concat(F.lit("ocr."), F.lower("label")))
    both = rule_signals.where("label <> 'SAFE'").select(*cols).unionByName(seen.select(*cols))
    return both.withColumn("source", F.lit("OCR"))


def image_classes(labels: dict[str, str], thresholds: dict[str, float] | None = None) -> dict[str, tuple[str, float]]:
    """A map of other detectors' classes for detection_signals: names are trimmed and folded and not empty, labels
    are SCAM or NSFW, thresholds from 0 to 1."""
    clean = {k.strip().casefold(): v for k, v in labels.items()}
    least = {k.strip().casefold(): v for k, v in (thresholds or {}).items()}
    if "" in clean or any(v not in ("SCAM", "NSFW") for v in clean.values()):
        raise ValueError("classes have names and map to SCAM or NSFW")
    if any(not 0 <= v <= 1 for v in least.values()):
        raise ValueError("thresholds are from 0 to 1")
    return {k: (v, float(least.get(k, 0.0))) for k, v in clean.items()}


def check_manifest(manifest: dict, sha256: str) -> None:
    """Raise unless a detector's manifest is whole and names the model file with this digest."""
    need = {"schema_version": "1", "model_name": r".{1,128}", "model_version": r".{1,128}", "license": "MIT", "source_repository": r"https://.+", "source_commit": "[0-9a-f]{40}", "onnx_sha256": "[0-9a-f]{64}", "output_layout": "xywh_objectness_classes|xywh_classes"}
    wrong = [k for k, p in need.items() if not re.fullmatch(p, str(manifest.get(k, "")))]
    names = list(manifest.get("class_names", []))
    if not 1 <= len(names) <= 128 or len(set(names)) != len(names):
        wrong.append("class_names")
    if not isinstance(manifest.get("input_size"), int) or not 320 <= manifest["input_size"] <= 1280:
        wrong.append("input_size")
    if manifest.get("onnx_sha256") != sha256:
        wrong.append("checksum")
    if wrong:
        raise ValueError(f"manifest: {wrong}")


def disabled(attachments: DataFrame, provider: str) -> DataFrame:
    """What a provider that is switched off says of each attachment: nothing, and a warning."""
    return attachments.withColumns({"text": F.lit(None).cast("string"), "detections": F.array().cast("array<string>"), "warnings": F.array(F.lit(f"{provider}_disabled"))})
