"""Column functions: text and hashes, vectors, time, ids and templates."""

from .ids import deterministic_id
from .templates import default_email, org_name, user_name
from .text import JS_SPACE, content_hash, js_trim, norm_text, present, utf16_slice
from .timing import parse_event_time, structured_attributes
from .vectors import checked_dimension, cosine_distance, vector_from_json

__all__ = [
    "JS_SPACE", "checked_dimension", "content_hash", "cosine_distance", "default_email", "deterministic_id", "js_trim", "norm_text", "org_name",
    "parse_event_time", "present", "structured_attributes", "user_name", "utf16_slice", "vector_from_json",
]
