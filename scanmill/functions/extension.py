"""Extension points: adding packs, packs as rows, and a table function for all spans of a pack's fields."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from scanmill.functions.packs import PACKS
from scanmill.functions.rules import Field, Pack, Probe


def register_pack(pack: Pack, packs: Sequence[Pack] = PACKS, position: int | None = None) -> list[Pack]:
    """Pack list with one more pack, last or at a position; the code must be new."""
    if any(p.code == pack.code for p in packs):
        raise ValueError(f"pack {pack.code} exists")
    out = list(packs)
    out.insert(len(out) if position is None else position, pack)
    return out


def pack_to_json(pack: Pack) -> str:
    """A pack as one row of a rule table."""
    return json.dumps(asdict(pack), ensure_ascii=False)


def _tuples(x):
    return tuple(_tuples(y) if isinstance(y, list) and y and isinstance(y[0], str) and y[0] in ("or", "and", "any", "count", "rx", "rxi") else y for y in x)


def pack_from_json(text: str) -> Pack:
    d = json.loads(text)
    fields = [Field(**{**f, "probes": [Probe(**p) for p in f["probes"]], "between": tuple(f["between"]) if f["between"] else None}) for f in d["fields"]]
    return Pack(**{**d, "detect": _tuples(d["detect"]), "fields": fields, "weights": [tuple(w) for w in d["weights"]]})


def span_function(packs: Sequence[Pack] = PACKS):
    """Table function ``extract_spans(text, pack)``: every match of every field with its position."""
    table = {p.code: [(f.name, q.java().replace("iu", "i"), q.group) for f in p.fields if not f.const for q in f.probes] for p in packs}

    class ExtractSpans:
        def __init__(self):
            import regex

            self.compiled = {code: [(n, regex.compile(p), g) for n, p, g in rows] for code, rows in table.items()}

        def eval(self, text: str, pack: str) -> Iterator[tuple[str, str, int, int]]:
            for name, rx, group in self.compiled.get(pack, []) if text else []:
                for m in rx.finditer(text):
                    yield name, m.group(group), m.start(group), m.end(group)

    return udtf(ExtractSpans, returnType="field string, value string, start int, end int")


def register_spans(spark: SparkSession, packs: Sequence[Pack] = PACKS) -> None:
    spark.udtf.register("extract_spans", span_function(packs))
