"""Nested telemetry-batch JSON (S6) and its validation.

A batch document is ``{"telemetry": {"batchId", "devices": [{"deviceId",
"readings": [{"metricId", "value", "unit", "recordedAt"}]}]}}``. Parsing is
``from_json`` with an explicit schema; flattening is two ``posexplode``s, so
every batch is handled inside the task that read it. Numbers that must be
checked for integrality are read as ``double``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Batch limits and the validator's issue texts.
MAX_DEVICES_PER_BATCH = 100
MAX_READINGS_PER_DEVICE = 50
ISSUE_BYTES_BUDGET = 4096
MSG_REQUIRED = "Required"
MSG_MIN_STRING = "String must contain at least 1 character(s)"
MSG_NOT_FINITE = "Number must be finite"
MSG_NOT_INT = "Expected integer, received float"
MSG_NEGATIVE = "Number must be greater than or equal to 0"
MSG_TOO_MANY_DEVICES = "Array must contain at most 100 element(s)"
MSG_TOO_MANY_READINGS = "Array must contain at most 50 element(s)"

BATCH_SCHEMA = ("telemetry struct<batchId:string, devices:array<struct<deviceId:string, "
                "readings:array<struct<metricId:string, value:double, unit:string, recordedAt:double>>>>>")


def parse_batches(docs: DataFrame, text: str = "doc") -> DataFrame:
    return docs.withColumn("batch", F.from_json(F.col(text), BATCH_SCHEMA))


def flatten(parsed: DataFrame) -> DataFrame:
    """One row per reading with its device and reading positions."""
    d = parsed.select(F.col("batch.telemetry.batchId").alias("batch_id"),
                      F.posexplode("batch.telemetry.devices").alias("device_index", "device"))
    r = d.select("batch_id", "device_index", F.col("device.deviceId").alias("device_id"),
                 F.posexplode("device.readings").alias("reading_index", "reading"))
    return r.select("batch_id", "device_index", "device_id", "reading_index",
                    F.col("reading.metricId").alias("metric_id"), F.col("reading.value").alias("value"),
                    F.col("reading.unit").alias("unit"), F.col("reading.recordedAt").alias("recorded_at"))


def _scalar_kind(x: Column) -> Column:
    """JSON type name of a VARIANT that is neither an array nor an object; a missing value is ``undefined``."""
    t = F.schema_of_variant(x)
    return (F.when(x.isNull(), "undefined").when(t == "VOID", "null").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
             .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number"))


def _container_kind(x: Column, fields: Column | None = None, elements: Column | None = None) -> Column:
    """JSON type name of a value whose object or array form is at hand, so a container's contents are not walked."""
    kind = _scalar_kind(x)
    if elements is not None:
        kind = F.when(elements.isNotNull(), F.lit("array")).otherwise(kind)
    return F.when(fields.isNotNull(), F.lit("object")).otherwise(kind) if fields is not None else kind


def _fields(x: Column) -> Column:
    """An object's fields by name, null for anything else."""
    return F.try_variant_get(x, "$", "map<string,variant>")


def _elements(x: Column) -> Column:
    """An array's elements, null for anything else."""
    return F.try_variant_get(x, "$", "array<variant>")


#: A check: its condition and the issue it gives.
Check = tuple[Column, Column]


def _issue(cond: Column, path: Column, code: str, message, order: Column, received=None) -> Check:
    text = F.lit(message) if isinstance(message, str) else message
    got = F.lit(received) if received is None or isinstance(received, str) else received
    return cond, F.when(cond, F.struct(path.alias("path"), F.lit(code).alias("code"), text.alias("message"),
                                       got.cast("string").alias("received"), order.alias("ord")))


def _wrong_type(kind: Column, expected: str, path: Column, order: Column, where: Column | None = None) -> Check:
    message = F.when(kind == "undefined", MSG_REQUIRED).otherwise(F.concat(F.lit(f"Expected {expected}, received "), kind))
    wrong = kind != expected
    return _issue(wrong if where is None else where & wrong, path, "invalid_type", message, order, kind)


def _text_checks(short: Column, kind: Column, path: Column, order, where: Column) -> list[Check]:
    """Checks of a non-empty string; ``order`` gives the place of its first and second check."""
    return [_wrong_type(kind, "string", path, order(0), where), _issue(where & short, path, "too_small", MSG_MIN_STRING, order(1))]


def _short(x: Column, kind: Column) -> Column:
    return (kind == "string") & (F.length(F.try_variant_get(x, "$", "string")) < 1)


def _any(checks: list[Check]) -> Column:
    """Whether a check fails; false where none can be told."""
    return F.coalesce(reduce(or_, [F.coalesce(c, F.lit(False)) for c, _ in checks]), F.lit(False))


def _found(checks: list[Check]) -> Column:
    """The issues of the checks, null where there are none, so sound values build nothing."""
    return F.when(_any(checks), F.array(*[i for _, i in checks]))


def _joined(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def issues(docs: DataFrame, key: str = "event_id", text: str = "doc") -> DataFrame:
    """One row per failed check of a document with its full path, in validation order.

    Returns ``(key, path, code, message, received, ord)``; documents are told
    apart by their own ``key``, never by the batch id they carry. The JSON is
    parsed once into a VARIANT, so missing fields, nulls and wrong types are
    told apart; text that is not JSON is a missing root. Checks below a value
    of the wrong type are skipped. Devices and readings are exploded into rows, so every
    value and its type are plain columns, taken once; the checks of a document or device travel
    with its first row. ``received`` is the type found, for type issues only. ``ord`` sorts issues
    as the validator reports them: root, batch id, device array, then per device itself, its id,
    its reading array and each reading's fields in schema order.
    """
    def place(*parts) -> Column:
        return F.array(*[F.lit(p) if isinstance(p, int) else p for p in parts])

    top_path = F.lit("telemetry.devices")
    d = docs.select(key, F.try_parse_json(F.col(text)).alias("_v")).withColumn("_root", _fields(F.col("_v")))
    d = d.withColumn("_t", F.col("_root")["telemetry"]).withColumn("_telemetry", _fields(F.col("_t")))
    d = d.withColumn("_batch", F.col("_telemetry")["batchId"]).withColumn("_list", F.col("_telemetry")["devices"]).withColumn("_devices", _elements(F.col("_list")))
    d = d.withColumn("_batch_kind", _scalar_kind(F.col("_batch")))
    is_object, has_telemetry = F.col("_root").isNotNull(), F.col("_telemetry").isNotNull()
    top = _found([
        _wrong_type(_container_kind(F.col("_v"), F.col("_root")), "object", F.lit("(root)"), place(0, -1, -1, 0)),
        _wrong_type(_container_kind(F.col("_t"), F.col("_telemetry")), "object", F.lit("telemetry"), place(0, -1, -1, 1), is_object),
        *_text_checks(_short(F.col("_batch"), F.col("_batch_kind")), F.col("_batch_kind"), F.lit("telemetry.batchId"), lambda n: place(1, -1, -1, n), has_telemetry),
        _wrong_type(_container_kind(F.col("_list"), elements=F.col("_devices")), "array", top_path, place(2, -1, -1, 0), has_telemetry),
        _issue(F.size("_devices") > MAX_DEVICES_PER_BATCH, top_path, "too_big", MSG_TOO_MANY_DEVICES, place(2, -1, -1, 1))])
    d = d.select(key, top.alias("_top"), F.posexplode_outer("_devices").alias("_d", "_device"))

    d = d.withColumn("_device_fields", _fields(F.col("_device")))
    d = d.withColumn("_id", F.col("_device_fields")["deviceId"]).withColumn("_list", F.col("_device_fields")["readings"])
    d = d.withColumn("_readings", _elements(F.col("_list"))).withColumn("_id_kind", _scalar_kind(F.col("_id")))
    path = F.concat(F.lit("telemetry.devices["), F.col("_d").cast("string"), F.lit("]"))
    here, sound = F.col("_d").isNotNull(), F.col("_device_fields").isNotNull()

    def of_device(n: int) -> Column:
        return place(3, F.col("_d"), -1, n)

    own = _found([
        _wrong_type(_container_kind(F.col("_device"), F.col("_device_fields")), "object", path, of_device(0), here),
        *_text_checks(_short(F.col("_id"), F.col("_id_kind")), F.col("_id_kind"), F.concat(path, F.lit(".deviceId")), lambda n: of_device(1 + n), sound),
        _wrong_type(_container_kind(F.col("_list"), elements=F.col("_readings")), "array", F.concat(path, F.lit(".readings")), of_device(3), sound),
        _issue(F.size("_readings") > MAX_READINGS_PER_DEVICE, F.concat(path, F.lit(".readings")), "too_big", MSG_TOO_MANY_READINGS, of_device(4))])
    first = F.coalesce(F.col("_d") == 0, F.lit(True))
    d = d.withColumn("_own", own)
    d = d.select(key, "_d", F.when(first, _joined(F.col("_top"), F.col("_own"))).otherwise(F.col("_own")).alias("_own"),
                 F.posexplode_outer("_readings").alias("_i", "_reading"))

    d = d.withColumn("_f", _fields(F.col("_reading")))
    names = {"_metric": "metricId", "_value": "value", "_unit": "unit", "_when": "recordedAt"}
    d = d.select(key, "_d", "_own", "_i", "_reading", F.col("_f").isNotNull().alias("_is_reading"), *[F.col("_f")[f].alias(c) for c, f in names.items()])
    d = d.select("*", *[_scalar_kind(F.col(c)).alias(f"{c}_kind") for c in names],
                 F.try_variant_get("_value", "$", "double").alias("_number"), F.try_variant_get("_when", "$", "double").alias("_moment"))
    d = d.select("*", *[_short(F.col(c), F.col(f"{c}_kind")).alias(f"{c}_short") for c in ("_metric", "_unit")])
    path = F.concat(F.lit("telemetry.devices["), F.col("_d").cast("string"), F.lit("].readings["), F.col("_i").cast("string"), F.lit("]"))
    here, sound = F.col("_i").isNotNull(), F.col("_is_reading")
    infinite = F.lit(float("inf"))
    moment = F.col("_moment")
    whole = (moment == F.floor(moment)) & (F.abs(moment) != infinite)

    def field(name: str) -> Column:
        return F.concat(path, F.lit(f".{name}"))

    def order(n: int) -> Column:
        return place(3, F.col("_d"), F.col("_i"), n)

    is_number = F.col("_when_kind") == "number"
    checks = [
        _wrong_type(F.when(sound, "object").otherwise(_scalar_kind(F.col("_reading"))), "object", path, order(0), here),
        *_text_checks(F.col("_metric_short"), F.col("_metric_kind"), field("metricId"), lambda n: order(1 + n), sound),
        _wrong_type(F.col("_value_kind"), "number", field("value"), order(3), sound),
        _issue((F.col("_value_kind") == "number") & (F.abs("_number") == infinite), field("value"), "not_finite", MSG_NOT_FINITE, order(4)),
        *_text_checks(F.col("_unit_short"), F.col("_unit_kind"), field("unit"), lambda n: order(5 + n), sound),
        _wrong_type(F.col("_when_kind"), "number", field("recordedAt"), order(7), sound),
        _issue(is_number & ~whole, field("recordedAt"), "invalid_type", MSG_NOT_INT, order(8), "float"),
        _issue(is_number & (moment < 0), field("recordedAt"), "too_small", MSG_NEGATIVE, order(9))]
    d = d.withColumn("_own", F.when(F.coalesce(F.col("_i") == 0, F.lit(True)), F.col("_own")))
    # the outer form: a filter in front of the generator would be pushed down and work out every type again
    found = d.select(key, F.explode_outer(_joined(F.col("_own"), _found(checks))).alias("i")).where("i is not null")
    return found.select(key, "i.path", "i.code", "i.message", "i.received", F.col("i.ord").alias("ord"))


def issue_budget(issue_rows: DataFrame, max_bytes: int = ISSUE_BYTES_BUDGET, key: str = "event_id") -> DataFrame:
    """Per document, the longest front run of paths whose JSON list fits in
    ``max_bytes`` bytes, and whether paths were dropped.

    The JSON list ``["a","b"]`` takes ``2 + sum(len(json(path))) + (n - 1)``
    bytes, so a running sum over the issue order decides inclusion. The issues
    of one document are as many as its own fields, so the window and the
    list stay as small as a document.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    one = F.octet_length(F.to_json(F.array(F.col("path")))) - 2  # the quoted, escaped path
    d = issue_rows.withColumn("_bytes", F.sum(one + 1).over(w) + 1)
    return (d.groupBy(key)
             .agg(F.count(F.lit(1)).alias("error_count"),
                  F.sort_array(F.collect_list(F.when(F.col("_bytes") <= max_bytes, F.struct("ord", "path")))).alias("_kept"),
                  F.max("_bytes").alias("_total"))
             .select(key, "error_count",
                     F.to_json(F.transform("_kept", lambda x: x["path"])).alias("paths_json"),
                     (F.col("_total") > max_bytes).alias("truncated")))
