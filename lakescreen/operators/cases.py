"""Cases judged by rules: metadata anomalies, gates of a face image, scripted checkpoints, explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import has_token

# Metadata keys that name software, tokens of editors and of cameras, table numbers of plain encoders.
SOFTWARE_KEYS = ("Software", "ProcessingSoftware", "Artist", "XPAuthor", "XPComment", "ImageHistory", "HistorySoftwareAgent")
EDITOR_TOKENS = (
    "photoshop", "gimp", "lightroom", "paint.net", "pixelmator", "affinity",
    "snapseed", "picsart", "canva", "illustrator", "corel", "acdsee",
    "capture one", "darktable", "krita", "figma", "pixel", "pica",
)
CAMERA_TOKENS = (
    "microsoft", "windows", "apple", "ios", "android", "google", "samsung",
    "huawei", "xiaomi", "oneplus", "motorola", "iphone", "pixel camera",
)
PLAIN_TABLES = (0, 1)
# Points of metadata anomalies and their cap.
EDITOR_POINTS, STRIPPED_POINTS, PARTIAL_POINTS, METADATA_CAP = 10.0, 5.0, 4.0, 15.0


def metadata_indicators(meta: Column) -> Column:
    """Indicators (type, severity, confidence, note) of meta: STRUCT<format, has_exif, has_xmp, tags MAP, text_chunks MAP, quant_tables ARRAY<INT>>."""
    tags = F.coalesce(meta["tags"], F.expr("cast(map() as map<string,string>)"))
    chunks = F.coalesce(meta["text_chunks"], F.expr("cast(map() as map<string,string>)"))
    tag = lambda name: F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(""))
    values = F.concat(F.map_values(F.map_filter(tags, lambda k, v: k.isin(*SOFTWARE_KEYS))), F.map_values(chunks))
    edited = F.exists(values, lambda v: has_token(v, EDITOR_TOKENS))
    exif, xmp, jpg = (F.coalesce(c, F.lit(False)) for c in (meta["has_exif"], meta["has_xmp"], meta["format"] == "jpg"))
    no_camera = exif & (tag("Make") == "") & (tag("Model") == "") & (tag("Software") != "") & ~has_token(tag("Software"), CAMERA_TOKENS)
    odd_table = jpg & F.exists(F.coalesce(meta["quant_tables"], F.array().cast("array<int>")), lambda t: ~t.isin(*PLAIN_TABLES))

    def one(when: Column, severity: str, confidence: float, note: str) -> Column:
        return F.when(when, F.struct(F.lit("metadata_anomaly").alias("type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(note).alias("note")))

    return F.array_compact(
        F.array(
            one(edited, "medium", 0.7, "editing software named"),
            one(~edited & xmp, "info", 0.2, "packet without a known editor"),
            one(jpg & ~exif, "low", 0.45, "all camera data stripped"),
            one(~(jpg & ~exif) & no_camera, "low", 0.4, "software without a camera"),
            one((tag("DateTime") != "") & (tag("DateTimeOriginal") == "") & exif, "info", 0.25, "no time of capture"),
            one(odd_table, "info", 0.3, "quantisation table of a re-encoder"),
        )
    )


def metadata_points(indicators: Column, has_xmp: Column, has_exif: Column) -> Column:
    """Points for metadata anomalies: medium and low ones each, a packet without camera data, METADATA_CAP together."""
    count = lambda s: F.size(F.filter(indicators, lambda i: (i["type"] == "metadata_anomaly") & (i["severity"] == s)))
    partial = F.coalesce(has_xmp, F.lit(False)) & ~F.coalesce(has_exif, F.lit(False))
    return F.least(F.lit(METADATA_CAP), count("medium") * EDITOR_POINTS + count("low") * STRIPPED_POINTS + F.when(partial, PARTIAL_POINTS).otherwise(0.0))


def face_gate(width: Column, height: Column, faces: Column, side: Column, extreme_pose: Column, occluded: Column, blocking: Column, least_image: int = 120, least_face: int = 48) -> Column:
    """Why a face image cannot be used (the first reason), or null; several faces alone do not stop it."""
    return (
        F.when(width.isNull() | height.isNull() | (F.least(width, height) <= 0), "image_unreadable")
        .when(F.least(width, height) < least_image, "image_too_small")
        .when(F.coalesce(faces, F.lit(0)) == 0, "no_face_detected")
        .when(side < least_face, "face_too_small")
        .when(extreme_pose, "extreme_pose")
        .when(occluded, "face_occluded")
        .when(F.size(blocking) > 0, F.try_element_at(blocking, F.lit(1)))
    )


def face_verdict(document: Column, probe: Column, many: Column, similarity: Column) -> Column:
    """STRUCT<verdict, reason>: inconclusive while either image is stopped by a gate or there is no similarity; several faces are told beside a verdict."""
    stop = F.coalesce(document, probe)
    verdict = F.when(stop.isNotNull() | similarity.isNull(), "INCONCLUSIVE").when(similarity >= 0.363, "MATCH").when(similarity <= 0.25, "NO_MATCH").otherwise("INCONCLUSIVE")
    reason = F.when(stop.isNotNull(), stop).when(similarity.isNull(), "no_embedding").when(many, "multiple_faces").when(verdict == "INCONCLUSIVE", "ambiguous_similarity")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def checkpoints(case_id: Column, ocr_ok: Column, ocr_confidence: Column, failures: Column, tampering: Column, face: Column, score: Column, low_max: Column, review: Column, audited: Column) -> Column:
    """What each scripted case is expected to show: ARRAY<STRUCT<checkpoint, ok, informational>>; null for a case that is not scripted."""
    row = lambda name, ok, info=False: F.struct(F.lit(name).alias("checkpoint"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(info).alias("informational"))
    clean, low = failures == 0, score <= low_max
    raised = score > low_max
    end = [row("Audit recorded", audited)]
    looks = row("Human review required", review)
    known = {
        "case1_valid": [row("OCR successful", ocr_ok), row("Validation passes", clean), row("No obvious tampering", tampering == "no_obvious_manipulation"), row("Face match", face == "MATCH"), row("Low risk", low)],
        "case2_tampered": [row("OCR successful", ocr_ok), row("Validation may pass", F.lit(True), True), row("Tampering indicators detected", tampering.isin("suspicious", "likely_manipulated")), row("Risk increased", raised), looks],
        "case3_identity_mismatch": [row("Document information extracted", ocr_ok), row("Document validation passes", clean), row("Face verification fails", face.isin("NO_MATCH", "INCONCLUSIVE")), row("High risk", raised), looks],
        "case4_low_quality": [row("Low OCR confidence", F.coalesce(ocr_confidence < 0.6, F.lit(False)) | ~F.coalesce(ocr_ok, F.lit(False))), row("Inconclusive validation where appropriate", F.lit(True), True), looks],
    }
    out = None
    for name, rows in known.items():
        made = F.array(*rows, *end)
        out = F.when(case_id == name, made) if out is None else out.when(case_id == name, made)
    return out


def checkpoint_counts(checks: Column) -> Column:
    """STRUCT<total, met, failed, informational> of a case's checkpoints; an informational one is neither met nor failed."""
    n = lambda keep: F.size(F.filter(checks, keep)).cast("long")
    return F.struct(
        F.size(checks).cast("long").alias("total"), n(lambda c: ~c["informational"] & c["ok"]).alias("met"), n(lambda c: ~c["informational"] & ~c["ok"]).alias("failed"), n(lambda c: c["informational"]).alias("informational")
    )


def explanation(verdict: Column, risk: Column, kinds: Column, failures: Column) -> Column:
    """One sentence for a forensic verdict: which kinds of indicators fired, or what kept the analysis from an end."""
    fired = F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(kinds)), ", "), F.lit("")), F.lit("none"))
    why = F.coalesce(F.nullif(F.array_join(failures, ", "), F.lit("")), F.lit("low image coverage/quality"))
    points = F.bround(risk, 0).cast("int").cast("string")
    return (
        F.when(verdict == "likely_manipulated", F.concat(F.lit("independent signals agree ("), fired, F.lit("); risk "), points, F.lit("/100")))
        .when(verdict == "suspicious", F.concat(F.lit("some signals fired ("), fired, F.lit("); risk "), points, F.lit("/100")))
        .when(verdict == "inconclusive", F.concat(F.lit("not completed ("), why, F.lit(")")))
        .otherwise(F.lit("nothing to flag"))
    )


def review_reasons(score: Column, level: Column, degraded: Column, medium_max: int = 49) -> Column:
    """Why a case goes to a person; one reason at least. Four degraded stages are named at most."""
    made = F.array_compact(
        F.array(
            F.when(score >= medium_max + 1, F.concat(F.lit("score "), F.bround(score, 0).cast("int").cast("string"), F.lit(" above the medium band"))),
            F.when(level.isin("MEDIUM", "HIGH", "CRITICAL"), F.concat(F.lit("level "), level)),
            F.when(F.size(degraded) > 0, F.concat(F.lit("degraded: "), F.array_join(F.slice(degraded, 1, 4), ", "))),
        )
    )
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.lit("low risk, confirmation by policy")))


def or_unavailable(risk: Column, error: Column) -> Column:
    """A risk STRUCT<score, level, confidence, human_review_required>, or, where it failed, one of nulls that forces a review."""
    none = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("human_review_required"))
    return F.when(error.isNull() & risk["score"].isNotNull(), risk).otherwise(none)


def status_counts(statuses: Column) -> Column:
    """STRUCT<passed, warnings, failed> of check statuses."""
    n = lambda s: F.size(F.filter(statuses, lambda x: x == s)).cast("long")
    return F.struct(n("PASS").alias("passed"), n("WARNING").alias("warnings"), n("FAIL").alias("failed"))


def private_network(host: Column) -> Column:
    """Whether an IPv4 host is loopback, private or link-local; false for anything else."""
    p = F.split(host, r"\.")
    n = [F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    valid = (F.size(p) == 4) & n[0].between(0, 255) & n[1].between(0, 255) & n[2].between(0, 255) & n[3].between(0, 255)
    inside = n[0].isin(10, 127, 0) | ((n[0] == 172) & n[1].between(16, 31)) | ((n[0] == 192) & (n[1] == 168)) | ((n[0] == 169) & (n[1] == 254))
    return F.coalesce(valid & inside, F.lit(False))
