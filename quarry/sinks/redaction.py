"""Whole tables made safe to publish, whatever their schema: applied last, right before a sink.

Every string goes through the redaction of its kind. One Arrow pass, no shuffle; nested columns are rewritten in place, and
each distinct string of a batch is redacted once.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.functions.urls import redact_reference, redact_text

#: Fields that hold addresses which may be relative.
REFERENCES = frozenset("href base_href ids seeds sitemap_urls".split())
#: Lists of signals whose `value` is an address.
ADDRESSED = frozenset(["canonicals"])
#: Fields that may name files of the machine that built the site.
PATHS = frozenset("detail source_manifest warnings build_directory root".split())
#: Fixed value: social properties whose value is an address.
_ADDRESS_PROPERTY = re.compile(r"og:(url|image|video|audio)(:(url|secure_url))?|twitter:(url|image(:src)?|player(:stream)?)")


class Redactor:
    """Redaction of Arrow arrays by field name."""

    def __init__(self, secrets: tuple[str, ...] = (), local_paths: tuple[str, ...] = ()):
        self.secrets = tuple(sorted(filter(None, secrets), key=len, reverse=True))
        self.local_paths = tuple(sorted(filter(None, local_paths), key=len, reverse=True))

    def text(self, value: str, name: str = "") -> str:
        if name in PATHS:
            for p in self.local_paths:
                value = value.replace(p, ".")
        value = redact_text(value, self.secrets)
        return redact_reference(value) if name in REFERENCES else value

    def strings(self, array: pa.Array, name: str) -> pa.Array:
        d = array.dictionary_encode()
        safe = pa.array([None if v is None else self.text(v, name) for v in d.dictionary.to_pylist()], array.type)
        return safe.take(d.indices)

    def array(self, array: pa.Array, name: str = "", around: str = "") -> pa.Array:
        """The redacted array of a field; `around` names the list whose elements hold it."""
        kind = array.type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            return self.strings(array, "href" if name == "value" and around in ADDRESSED else name)
        if pa.types.is_map(kind):
            lo, hi = array.offsets[0].as_py(), array.offsets[-1].as_py()
            names, values = array.keys.slice(lo, hi - lo), array.items.slice(lo, hi - lo)
            out = pa.MapArray.from_arrays(_offsets(array), self.array(names, "", name), self.array(values, "", name))
            return out.cast(kind)
        if pa.types.is_list(kind):
            out = pa.ListArray.from_arrays(_offsets(array), self.array(array.flatten(), name, name))
            return out.cast(kind)
        if pa.types.is_struct(kind):
            fields = [kind.field(k) for k in range(kind.num_fields)]
            parts = {f.name: self.array(part, f.name, around) for f, part in zip(fields, array.flatten(), strict=True)}
            if {"property", "value"} <= set(parts):
                parts["value"] = self._social(array.field("property"), parts["value"])
            return pa.StructArray.from_arrays(list(parts.values()), fields=fields, mask=array.is_null())
        return array

    def _social(self, properties: pa.Array, values: pa.Array) -> pa.Array:
        """Values of social tags are addresses where the property says so."""
        both = zip(properties.to_pylist(), values.to_pylist(), strict=True)
        return pa.array([redact_reference(v) if v is not None and _ADDRESS_PROPERTY.fullmatch(p or "") else v for p, v in both], values.type)


def _offsets(array) -> pa.Array:
    """Offsets from 0, null where the list is null, as `from_arrays` wants them. Null lists hold nothing in Spark's batches."""
    starts = pc.subtract(array.offsets, array.offsets[0])
    gone = pa.concat_arrays([array.is_null(), pa.array([False])])
    return pc.if_else(gone, pa.scalar(None, pa.int32()), starts)


def redacted(table: DataFrame, secrets: tuple[str, ...] = (), local_paths: tuple[str, ...] = ()) -> DataFrame:
    """The table with every string redacted: addresses lose credentials and secret parameters, `secrets` are hidden,
    `local_paths` become a dot in the fields that name files. Nulls, numbers and the schema stay.
    """
    safe = Redactor(secrets, local_paths)

    def run(batches):
        for b in batches:
            columns = [safe.array(b.column(k), b.schema.field(k).name) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return table.mapInArrow(run, table.schema)
