"""Page outputs: JSON, XML, text and DOCX bodies as columns, and the files themselves."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.session import ship
from vellum.sources.page_files import stems, write_files


def _ordered(*cols) -> Column:
    return F.sort_array(F.collect_list(F.struct("line_idx", *cols)))


def _item() -> Column:
    """A line in the page's JSON; the names are fixed values."""
    return F.struct(
        G.corners().alias("boundingBox"), F.col("line_idx").alias("id"), F.when(F.col("is_vertical"), "true").otherwise("false").alias("isVertical"),
        F.col("text"), F.lit("true").alias("isTextline"), F.col("confidence"),
    )


def _json_document(items: str, kind) -> Column:
    info = F.struct(F.col("width").alias("img_width"), F.col("height").alias("img_height"), F.col("path").alias("img_path"), F.col("name").alias("img_name"))
    return F.to_json(F.struct(F.array(F.coalesce(items, F.array().cast(kind))).alias("contents"), info.alias("imginfo")))


def page_json(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, json): one document per page; ``pages`` has page_id, width, height, path, name."""
    grouped = lines.withColumn("item", _item()).groupBy("page_id").agg(F.transform(_ordered("item"), lambda x: x.item).alias("items"))
    return pages.join(grouped, "page_id", "left").select("page_id", _json_document("items", grouped.schema["items"].dataType).alias("json"))


def pretty_json(document: str) -> str:
    return json.dumps(json.loads(document), indent=2, ensure_ascii=False)


#: The parts of the page's XML.
XML_LINE = '      <LINE TYPE="line_main" X="%d" Y="%d" WIDTH="%d" HEIGHT="%d" CONF="%.3f" STRING="%s" ORIENT="%s"></LINE>\n'
XML_HEAD = '<?xml version="1.0" encoding="utf-8" standalone="yes"?>\n<OCRDATASET xmlns="">\n  <PAGE IMAGENAME="%s" WIDTH="%d" HEIGHT="%d">\n    <TEXTBLOCK>\n'
XML_TAIL = "    </TEXTBLOCK>\n  </PAGE>\n</OCRDATASET>\n"


def _xml_line() -> Column:
    return F.format_string(
        XML_LINE, F.col("x0"), F.col("y0"), F.greatest(F.col("x1") - F.col("x0"), F.lit(1)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1)), F.col("confidence").cast("double"),
        T.escape_xml(F.col("text")), F.when(F.col("is_vertical"), "vertical").otherwise("horizontal"),
    )


def _xml_document(body: Column) -> Column:
    return F.concat(F.format_string(XML_HEAD, F.col("name"), F.col("width"), F.col("height")), F.coalesce(body, F.lit("")), F.lit(XML_TAIL))


def page_xml(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, xml). Texts are escaped, the image name is not."""
    grouped = lines.withColumn("line", _xml_line()).groupBy("page_id").agg(F.array_join(F.transform(_ordered("line"), lambda x: x.line), "").alias("body"))
    return pages.join(grouped, "page_id", "left").select("page_id", _xml_document(F.col("body")).alias("xml"))


def docx_body(text: Column) -> Column:
    """The word/document.xml part: one paragraph per line; a final newline opens no line."""
    lines = F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")
    body = F.array_join(F.transform(lines, lambda s: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), T.escape_xml(s, quotes=False), F.lit("</w:t></w:r></w:p>"))), "")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">\n  <w:body>'
    return F.concat(F.lit(head), F.when(F.length(text) == 0, "<w:p/>").otherwise(body), F.lit("<w:sectPr/></w:body>\n</w:document>"))


#: The other two parts of the package.
CONTENT_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">\n'
    '  <Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>\n  <Default Extension="xml" ContentType="application/xml"/>\n'
    '  <Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>\n</Types>'
)
RELATIONSHIPS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">\n'
    '  <Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/>\n</Relationships>'
)


def docx_package(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", RELATIONSHIPS), ("word/document.xml", body)):
            z.writestr(name, part)
    return out.getvalue()


def page_docx(texts: DataFrame) -> DataFrame:
    """(page_id, text) -> (page_id, docx binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf.page_id, "docx": [docx_package(b) for b in pdf.body]})

    ship(texts.sparkSession)
    return texts.select("page_id", docx_body(F.col("text")).alias("body")).mapInPandas(run, "page_id bigint, docx binary")


def page_documents(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, name, json, xml, txt, docx_body) of every page; a page without lines has empty ones. The lines are grouped once."""
    made = lines.select("page_id", "line_idx", _item().alias("item"), _xml_line().alias("line"), "text")
    ordered = made.groupBy("page_id").agg(_ordered("item", "line", "text").alias("all"))
    parts = ordered.select("page_id", *[F.col("all").getField(c).alias(c) for c in ("item", "line", "text")])
    found = pages.join(parts, "page_id", "left").withColumn("txt", F.coalesce(F.array_join("text", "\n"), F.lit("")))
    return found.select("page_id", "name", _json_document("item", parts.schema["item"].dataType).alias("json"), _xml_document(F.array_join("line", "")).alias("xml"), "txt", docx_body(F.col("txt")).alias("docx_body"))


KINDS = ("json", "xml", "txt", "docx")


def write_page_files(lines: DataFrame, pages: DataFrame, folder: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Writes <stem>.<kind> of every page into ``folder``, by the tasks that made them; returns (page_id, kind, path) of all its files.

    ``folder`` is a URI or a path that all executors share. Stems come from the page's name; pages that share one carry their
    number as well. Either all files are listed in the folder's manifest or none is, see ``vellum.sources.page_files``.
    """
    ship(lines.sparkSession)
    documents = page_documents(lines, pages).drop("name").join(stems(pages, output_stem(F.lit(None).cast("string"), F.col("name"))), "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():  # a page's files at a time
                body = {k: docx_package(r["docx_body"]) if k == "docx" else (pretty_json(r["json"]) if k == "json" else r[k]).encode() for k in kinds}
                yield pa.RecordBatch.from_pylist([{"page_id": r["page_id"], "kind": k, "name": f"{r['stem']}.{k}", "body": b} for k, b in body.items()], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("body", pa.binary())])
    columns = [F.col("page_id").cast("long").alias("page_id"), "stem", "json", "xml", "txt", "docx_body"]
    return write_files(documents.select(*columns).mapInArrow(run, "page_id bigint, kind string, name string, body binary"), folder)


def output_stem(given: Column, path: Column) -> Column:
    """The stem of output files: the given one, else that of the input file, else ``output``."""
    own = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(F.regexp_replace(own, r"[/\x00]", "_"), F.lit("")), F.lit("output"))


def write_artifacts(lines: DataFrame, pages: DataFrame, path: str) -> None:
    """JSON, XML and text of every page as three Parquet tables under ``path``."""
    from vellum.operators.page_rules import page_text

    for name, df in (("json", page_json(lines, pages)), ("xml", page_xml(lines, pages)), ("text", page_text(lines))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def metrics_csv(metrics: DataFrame, path: str) -> None:
    """Per-file metrics with rates to six places."""
    fixed = lambda c: F.format_string("%.6f", F.col(c)).alias(c)
    metrics.select("system", F.col("relpath").alias("file"), fixed("cer"), fixed("wer"), "char_errors", "char_total", "word_errors", "word_total").write.mode("overwrite").csv(path, header=True)


def timing_csv(timing: DataFrame, path: str) -> None:
    """stem and seconds to six places."""
    timing.select("stem", F.format_string("%.6f", F.col("wall_seconds")).alias("wall_seconds")).write.mode("overwrite").csv(path, header=True)


def timing_markdown(timing: DataFrame) -> str:
    """Files, total and mean seconds."""
    from vellum.operators.evaluate import timing_summary

    r = timing_summary(timing).first()
    return f"## Timing\n\n- files: {r.files}\n- total seconds: {r.total_seconds or 0.0:.3f}\n- mean seconds: {r.mean_seconds or 0.0:.3f}\n"


def combined_report(title: str, timing: DataFrame, systems: DataFrame, missing: DataFrame, level: str, baseline: str | None = None) -> str:
    """Timing and accuracy in one document."""
    return f"# {title}\n\n{timing_markdown(timing)}\n## Accuracy\n\n{markdown_report(systems, missing, level, baseline=baseline)}"


def comparison_report(title: str, timings: dict[str, DataFrame], systems: DataFrame, missing: DataFrame, level: str, baseline: str) -> str:
    """The timings of several engines, how much faster each is than the baseline, and their accuracy with differences from it."""
    from vellum.operators.evaluate import timing_summary

    took = {name: timing_summary(t).first() for name, t in timings.items()}
    out = [f"# {title}", "", f"Baseline: {baseline}", "", "| engine | files | total seconds | mean seconds | times as fast |", "|-|-|-|-|-|"]
    for name, r in took.items():
        known = baseline in took and took[baseline].mean_seconds and r.mean_seconds
        out.append(f"| {name} | {r.files} | {r.total_seconds or 0.0:.3f} | {r.mean_seconds or 0.0:.3f} | {f'{took[baseline].mean_seconds / r.mean_seconds:.2f}' if known else '-'} |")
    return "\n".join(out) + "\n\n## Accuracy\n\n" + markdown_report(systems, missing, level, baseline=baseline)


def summary_lines(systems: DataFrame, baseline: str | None = None) -> list[str]:
    """A line of CSV for each of a few systems, best first; with signed differences if a baseline is named."""
    from vellum.operators.evaluate import deltas

    rows = systems.orderBy("cer", "system").collect()
    shift = {r.system: r for r in deltas(systems, baseline).collect()} if baseline else {}
    head = "system,cer,wer" + (",delta_cer,delta_wer" if baseline else "")
    return [head, *[f"{r.system},{r.cer:.6f},{r.wer:.6f}" + (f",{shift[r.system].delta_cer:+.6f},{shift[r.system].delta_wer:+.6f}" if r.system in shift else "") for r in rows]]


def _accuracy_table(rows: list, base) -> list[str]:
    """Rows of (system, cer, wer, matched, missing); with signed differences from ``base`` if there is one."""
    out = ["| system | matched | missing | CER | WER |" + (" ΔCER | ΔWER |" if base else ""), "|-|-|-|-|-|" + ("-|-|" if base else "")]
    for r in rows:
        shift = f" {r.cer - base.cer:+.6f} | {r.wer - base.wer:+.6f} |" if base else ""
        out.append(f"| {r.system} | {r.matched} | {r.missing} | {r.cer:.6f} | {r.wer:.6f} |{shift}")
    return out


def markdown_report(systems: DataFrame, missing: DataFrame, level: str, n: int = 30, baseline: str | None = None) -> str:
    """A report of a few systems: rows by error rate, with differences from the baseline if one is named, then each system's first missing files."""
    from vellum.operators.evaluate import top_missing, with_missing

    rows = (systems if "missing" in systems.columns else with_missing(systems, missing)).orderBy("cer", "system").collect()
    base = next((r for r in rows if r.system == baseline), None)
    out = [f"Normalisation: {level}", *([f"Baseline: {baseline}"] if base else []), "", *_accuracy_table(rows, base)]
    shown: dict[str, list] = {}
    for r in top_missing(missing, n).orderBy("system", "rank").collect():
        shown.setdefault(r.system, []).append(r)
    for system, rows in shown.items():
        out += ["", f"Missing from {system}:", *[f"- {r.relpath}" for r in rows], *([f"- … ({rows[0].more} more)"] if rows[0].more else [])]
    return "\n".join(out) + "\n"


def cube_report(cube: DataFrame, baseline: str | None = None) -> str:
    """A table for each normalisation level of ``evaluate.cube``, systems by error rate and the total last."""
    levels: dict[str, list] = {}
    for r in cube.orderBy("level", "is_total", "cer", "system").collect():  # a row per level and system
        levels.setdefault(r.level, []).append(r)
    out = []
    for level, rows in levels.items():
        named = [type(r)(**{**r.asDict(), "system": "all"}) if r.is_total else r for r in rows]
        base = next((r for r in rows if r.system == baseline and not r.is_total), None)
        out += [f"## {level}", "", *_accuracy_table(named, base), ""]
    return "\n".join(out)
