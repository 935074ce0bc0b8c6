"""Column-level functions (pure expressions, codegen-friendly)."""

from .predicates import (app_routes, is_5xx, is_error_span, is_ok, full_fidelity,  # noqa: F401
                         service_selector, label_eq, anchored_match, is_hex)
from .time import (epoch_us, parse_iso_strict, iso_utc, duration_seconds,  # noqa: F401
                   scoring_start, scoring_end)
from .scalars import (id_suffix, truncate_text, fault_metric, nan_to_null,  # noqa: F401
                      expected_signal, format_value)
