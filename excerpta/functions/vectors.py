"""Embedding profiles, vector identities, vector codecs and cosine similarity."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from excerpta.errors import VectorError
from excerpta.functions.identity import canonical_json, json_string

# --- fixed values -----------------------------------------------------------------------------
FLOATING_REVISIONS = ("auto", "current", "default", "latest", "unspecified")
CREDENTIAL_NAMES = (
    "access_token", "api_key", "apikey", "authorization", "credential", "credentials", "password", "secret", "token",
)
CREDENTIAL_ENDINGS = ("_api_key", "_credential", "_password", "_secret", "_token")
BATCH_SIZE = 10
# ----------------------------------------------------------------------------------------------

CONFIG = "preprocessing.config"
# What each leaf of a profile must be: (test, requirement). The configuration is one leaf.
NAME = (lambda v: isinstance(v, str) and v != "" and v == v.strip() and "\0" not in v, "a trimmed, non-empty name")
COUNT = (lambda v: type(v) is int and v > 0, "a whole number above 0")
LEAVES = {
    "provider": NAME,
    "model_id": NAME,
    "model_revision": (lambda v: NAME[0](v) and v.casefold() not in FLOATING_REVISIONS, "one fixed revision"),
    "dimensions": COUNT,
    "input_role": NAME,
    "instruction": (lambda v: isinstance(v, str) and "\0" not in v, "text"),
    "preprocessing.implementation": NAME,
    "preprocessing.version": COUNT,
    CONFIG: (lambda v: isinstance(v, dict), "an object"),
}


def _leaves(value, path=""):
    """(dotted path, value) of a profile's leaves."""
    if isinstance(value, dict) and path != CONFIG:
        return [leaf for key, inner in value.items() for leaf in _leaves(inner, f"{path}.{key}".lstrip("."))]
    return [(path, value)]


def _keys(value):
    """All object keys inside a JSON value."""
    if isinstance(value, dict):
        return [*value, *(k for inner in value.values() for k in _keys(inner))]
    return [k for inner in value for k in _keys(inner)] if isinstance(value, (list, tuple)) else []


def _names_credential(key) -> bool:
    spelled = re.sub("[^a-z0-9]+", "_", str(key).casefold()).strip("_")
    return spelled in CREDENTIAL_NAMES or spelled.endswith(CREDENTIAL_ENDINGS)


def profile_faults(profile) -> list[str]:
    """Everything that keeps a profile from being an identity; empty for a sound one."""
    leaves = dict(_leaves(profile))
    faults = [f"{path} is missing" for path in LEAVES if path not in leaves]
    faults += [f"{path} is not part of a profile" for path in leaves if path not in LEAVES]
    faults += [f"{path} must be {LEAVES[path][1]}" for path, value in leaves.items() if path in LEAVES and not LEAVES[path][0](value)]
    keys = _keys(leaves.get(CONFIG))
    faults += [f"{CONFIG} has a key that is no text" for key in keys if not isinstance(key, str)]
    return faults + [f"{CONFIG} names a credential: {key}" for key in keys if _names_credential(key)]


def checked_profile(profile):
    """A deep copy of a sound embedding profile; every leaf is part of the vector identity."""
    faults = profile_faults(profile)
    if faults:
        raise VectorError("; ".join(faults))
    try:
        return json.loads(canonical_json(profile))
    except (TypeError, ValueError) as error:
        raise VectorError("a profile holds plain JSON values only") from error


def profile_id(profile):
    return "profile_" + hashlib.sha256(canonical_json(checked_profile(profile)).encode()).hexdigest()


def input_json(profile, text) -> Column:
    """Canonical JSON of ``{profile, text}``, the exact input a vector is derived from."""
    return F.concat(F.lit('{"profile":' + canonical_json(profile) + ',"text":'), json_string(text), F.lit("}"))


def vector_object_id(profile, text) -> Column:
    return F.concat(F.lit("vec_"), F.sha2(input_json(profile, text), 256))


@F.arrow_udf(BinaryType())
def encode_vector(vectors: pa.Array) -> pa.Array:
    """Big-endian IEEE-754 doubles; a whole Arrow batch is one buffer. A null vector is null."""
    content = vectors.flatten().to_numpy(zero_copy_only=False).astype(">f8").tobytes()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(8 * sizes.astype("i8"))])
    made = pa.Array.from_buffers(pa.large_binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(content)])
    return pc.if_else(vectors.is_valid(), made, None).cast(pa.binary())


@F.arrow_udf(ArrayType(DoubleType()))
def decode_vector(payloads: pa.Array) -> pa.Array:
    """The doubles of :func:`encode_vector`, by one view of the batch's buffer; a payload of other than whole doubles is an
    error."""
    held = pc.fill_null(payloads, b"").cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], "i8")[held.offset : held.offset + len(held) + 1]
    if (offsets % 8 != offsets[0] % 8).any():
        raise ValueError("a vector payload is not a whole number of doubles")
    content = held.buffers()[2]
    values = np.frombuffer(content, ">f8", (offsets[-1] - offsets[0]) // 8, offsets[0]) if content is not None else np.empty(0)
    starts = pa.array(((offsets - offsets[0]) // 8).astype("i4"))
    return pa.ListArray.from_arrays(starts, pa.array(values.astype("f8")), mask=payloads.is_null())


def is_valid_vector(vector, dimensions) -> Column:
    """Right length and only finite numbers."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def scaled_unit(vector) -> Column:
    """Unit vector, scaled by the largest magnitude first so that squares cannot overflow."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    peak = F.array_max(F.transform(vector, F.abs))

    def scale(top):
        scaled = F.transform(vector, lambda x: x / top)
        return F.get(
            F.transform(
                F.array(scaled),
                lambda values: F.transform(
                    values,
                    lambda x: x / F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, y: acc + y * y)),
                ),
            ),
            F.lit(0),
        )

    return F.get(F.transform(F.array(peak), scale), F.lit(0))


def dot(left, right) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(unit_query: Column, vector: Column) -> Column:
    """Cosine with an already normalized query; a zero vector scores 0."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x)
    peak = F.array_max(F.transform(vector, F.abs))
    plain = dot(unit_query, vector) / F.sqrt(squares)
    usual = (squares > 1e-200) & (squares < 1e200)
    return F.when(peak == 0, 0.0).when(usual, plain).otherwise(dot(unit_query, scaled_unit(vector)))
