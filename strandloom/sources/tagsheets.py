"""Tag sheets: which primers and tags belong to which sample. They are configuration, read on the driver."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, Row, SparkSession

from strandloom.operators.reads import MAX_SHEET, Marker

# Parameter names of tag sheets and what they set.
PARAMETERS = {
    "spacer": ("forward_spacer", "reverse_spacer"), "forward_spacer": ("forward_spacer",), "reverse_spacer": ("reverse_spacer",),
    "tag_delimiter": ("forward_delimiter", "reverse_delimiter"), "forward_tag_delimiter": ("forward_delimiter",), "reverse_tag_delimiter": ("reverse_delimiter",),
    "matching": ("matching",), "forward_matching": ("matching",), "reverse_matching": ("matching",),
    "primer_mismatches": ("errors",), "forward_mismatches": ("errors",), "reverse_mismatches": ("errors",), "forward_primer_mismatches": ("errors",), "reverse_primer_mismatches": ("errors",),
    "indels": ("indels",), "forward_indels": ("indels",), "reverse_indels": ("indels",), "forward_indel": ("indels",), "reverse_indel": ("indels",),
}
_NUMBERS = {"forward_spacer", "reverse_spacer", "errors"}


def _tags(cell: str) -> tuple[str, str]:
    """Forward and reverse tag: ``a:b``, or one for both; a dash is none."""
    f, _, r = cell.strip().lower().partition(":")
    f, r = f.strip("-"), (r or f).strip("-")
    return f, r


def parse_sheet(text: str) -> list[Marker]:
    """Both forms: CSV with ``@param,name,value`` lines, or six blank-separated columns with ``@ key=value;`` at their end."""
    lines = [line for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    settings: dict[str, object] = {}
    rows: list[tuple[str, str, str, str, str]] = []
    table = [line for line in lines if "," in line]
    if len(table) * 2 > len(lines):
        body = []
        for cells in csv.reader(io.StringIO("\n".join(lines))):
            cells = [c.strip() for c in cells]
            if cells[0] == "@param":
                if cells[1] not in PARAMETERS:
                    raise ValueError(f"unknown parameter {cells[1]!r}")
                for name in PARAMETERS[cells[1]]:
                    v = cells[-1]
                    settings[name] = int(v) if name in _NUMBERS else v.lower() in ("true", "1", "yes") if name == "indels" else v
            else:
                body.append(cells)
        head = {c: i for i, c in enumerate(body[0])}
        missing = {"experiment", "sample", "sample_tag", "forward_primer", "reverse_primer"} - head.keys()
        if missing:
            raise ValueError(f"the tag sheet lacks {sorted(missing)}")
        rows = [tuple(cells[head[c]] for c in ("experiment", "sample", "sample_tag", "forward_primer", "reverse_primer")) for cells in body[1:]]
    else:
        for line in lines:
            cells = line.split("@")[0].split()
            rows.append(tuple(cells[:5]))
    if len(rows) > MAX_SHEET:
        raise ValueError(f"a tag sheet has at most {MAX_SHEET} rows")
    groups: dict[tuple[str, str], list] = {}
    for experiment, sample, tag, forward, reverse in rows:
        groups.setdefault((forward.lower(), reverse.lower()), []).append((*_tags(tag), experiment, sample))
    markers = []
    for (forward, reverse), samples in groups.items():
        if len({s[:2] for s in samples}) != len(samples):
            raise ValueError("two samples of a marker share their tags")
        sizes = [{len(s[i]) for s in samples} for i in (0, 1)]
        if any(len(s) > 1 for s in sizes) and not settings.get("forward_delimiter"):
            raise ValueError("tags of one side have one length")
        markers.append(Marker(forward, reverse, forward_tag_length=max(sizes[0]), reverse_tag_length=max(sizes[1]), samples=tuple(samples), **settings))
    return markers


def _bounded(rows: DataFrame, most: int) -> list[Row]:
    """All rows; more than ``most`` are an error, as configuration is held on the driver."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"configuration of more than {most} rows")
    return found


def read_sheet(spark: SparkSession, path: str) -> list[Marker]:
    """A sheet of at most MAX_SHEET rows; comments and parameters may be as many again."""
    return parse_sheet("\n".join(r["value"] for r in _bounded(spark.read.text(path), 2 * MAX_SHEET)))


def read_split_config(spark: SparkSession, path: str) -> dict[str, str]:
    """Columns tag[, pcr_pool]: name -> pattern."""
    rows = _bounded(spark.read.options(header="true").csv(path), MAX_SHEET)
    return {(r["pcr_pool"] if "pcr_pool" in r.__fields__ and r["pcr_pool"] else r["tag"]): r["tag"] for r in rows}


def example_sheet() -> str:
    return "@param,matching,strict\nexperiment,sample,sample_tag,forward_primer,reverse_primer\nexp1,s1,aattaac,TTAGATACCCCACTATGC,TAGAACAGGCTCCTCTAG\n"
