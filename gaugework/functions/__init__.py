from gaugework.functions.jsontext import (
    canonical_json,
    is_canonical_number,
    json_keys,
    json_kind,
    parse_strict,
)
from gaugework.functions.scalars import (
    at_least,
    at_most,
    bounded_duration,
    bounded_label,
    content_digest,
    decimal_diff,
    estimated_units,
    exact_mean,
    exact_sums,
    exact_total,
    merged_sums,
    metric_label,
    normalize_text,
    positive_duration,
    retry_delay,
    severity,
    slice_family,
    slice_value,
    status_class,
    to_utc,
    valid_code,
    valid_digest,
    valid_id,
    valid_metric,
    valid_slice,
)

__all__ = [
    "at_least", "at_most", "bounded_duration", "bounded_label", "canonical_json",
    "content_digest", "decimal_diff", "estimated_units",
    "exact_mean", "exact_sums", "exact_total", "merged_sums", "positive_duration", "is_canonical_number", "json_keys", "json_kind",
    "metric_label", "normalize_text", "parse_strict", "retry_delay", "severity",
    "slice_family", "slice_value", "status_class", "to_utc", "valid_code",
    "valid_digest", "valid_id", "valid_metric", "valid_slice",
]
