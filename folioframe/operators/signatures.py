"""Signature fields and what can be said of each, one row a signature."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.cos import Ref
from folioframe.functions.der import chain, cms_info, verified
from folioframe.functions.document import Pdf
from folioframe.operators.security import byte_range_warnings, contents_misplaced
from folioframe.sources.pdf import each_file, opened, text_string

_COLUMNS = (
    "obj_num long, field_name string, sub_filter string, byte_range array<long>, reason string, signed_at string, digest_match boolean, signature_ok boolean, "
    "signing_time timestamp, has_timestamp boolean, subjects array<string>, issuers array<string>, chain_ok boolean, not_before timestamp, not_after timestamp, "
    "mdp_level int, dss_crls int, dss_ocsps int, dss_certs int"
)


def signature_fields(pdf: Pdf) -> Iterator[tuple[Ref, str | None, dict[str, Any]]]:
    """Signature dictionaries by field, with those of all descendants."""
    form = pdf.resolve(pdf.catalog.get("AcroForm"))
    todo = list(pdf.resolve(form.get("Fields")) or []) if isinstance(form, dict) else []
    seen: set[Ref] = set()
    while todo:
        ref = todo.pop(0)
        node = pdf.resolve(ref)
        if not isinstance(node, dict) or ref in seen:
            continue
        seen.add(ref)
        value = pdf.resolve(node.get("V"))
        if node.get("FT") == "Sig" and isinstance(value, dict):
            yield ref, text_string(pdf.resolve(node.get("T"))), value
        todo += list(pdf.resolve(node.get("Kids")) or [])


def mdp_level(pdf: Pdf, signature: dict[str, Any]) -> int | None:
    """The permission level of a certification (1 to 3, 2 if not said), None for other signatures."""
    for r in pdf.resolve(signature.get("Reference")) or []:
        r = pdf.resolve(r)
        if isinstance(r, dict) and r.get("TransformMethod") == "DocMDP":
            parms = pdf.resolve(r.get("TransformParams")) or {}
            return parms.get("P", 2)
    return None


def signatures(files: DataFrame) -> DataFrame:
    """One row a signature. Digest and signature are null where they cannot be checked (B16)."""

    def rows(_: Any, content: bytes) -> Iterator[tuple]:
        pdf = opened(content, True)
        if not pdf:
            return
        dss = pdf.resolve(pdf.catalog.get("DSS"))
        dss = dss if isinstance(dss, dict) else {}
        counts = [len(pdf.resolve(dss.get(k)) or []) for k in ("CRLs", "OCSPs", "Certs")]
        for ref, name, sig in signature_fields(pdf):
            spans = [v for v in (pdf.resolve(sig.get("ByteRange")) or []) if isinstance(v, int)]
            contents = pdf.resolve(sig.get("Contents"))
            cms = cms_info(bytes(contents)) if isinstance(contents, bytes) else None
            match = None
            if cms and cms.digest_name and cms.message_digest is not None and len(spans) == 4:
                covered = b"".join(content[o : o + n] for o, n in zip(spans[::2], spans[1::2], strict=True))
                match = hashlib.new(cms.digest_name, covered).digest() == cms.message_digest
            leaf = cms.own if cms else None  # expiry and trust are the signer's
            path = chain(cms.certificates, leaf) if leaf else []
            yield (
                ref.num, name, str(sig["SubFilter"]) if "SubFilter" in sig else None, spans, text_string(pdf.resolve(sig.get("Reason"))), text_string(pdf.resolve(sig.get("M"))),
                match, cms.signature_ok if cms else None, cms.signing_time if cms else None, bool(cms and cms.has_timestamp),
                [c.subject for c in path], [c.issuer for c in path], verified(path) if path else None, leaf.not_before if leaf else None, leaf.not_after if leaf else None, mdp_level(pdf, sig), *counts,
            )

    return each_file(files, rows, _COLUMNS)


def judged(found: DataFrame, files: DataFrame, trusted: list[str], now: datetime) -> DataFrame:
    """Signatures with structural warnings, trust by a list of name parts, expiry at ``now``, and long-term validity.

    ``trusted`` goes by the names in the chain alone; ``trust_verified`` asks for its signatures too.
    """
    joined = found.join(files.select("file_id", "content"), "file_id")
    spans, content = F.col("byte_range"), F.col("content")
    parts = F.array(*[F.lit(t.lower()) for t in trusted]).cast("array<string>")
    known: Column = F.exists("subjects", lambda s: F.exists(parts, lambda p: F.contains(F.lower(s), p)))
    expired = (F.lit(now) > F.col("not_after")) | (F.lit(now) < F.col("not_before"))
    return joined.select(
        *found.columns,
        byte_range_warnings(content, spans).alias("usf_warnings"),
        contents_misplaced(content, spans).alias("swa_suspect"),
        known.alias("trusted"),
        (known & F.coalesce("chain_ok", F.lit(False)) & F.coalesce("signature_ok", F.lit(False)) & F.coalesce("digest_match", F.lit(False))).alias("trust_verified"),
        expired.alias("expired"),
        (((F.col("dss_crls") + F.col("dss_ocsps")) > 0) & F.col("has_timestamp")).alias("ltv"),
    )


def revision_of_signature(found: DataFrame, revisions: DataFrame) -> DataFrame:
    """The first revision that ends at or after what each signature covers."""
    covered = found.where(F.size("byte_range") == 4).select("file_id", "obj_num", (F.col("byte_range")[2] + F.col("byte_range")[3]).alias("covered"))
    joined = covered.join(revisions, "file_id").where(F.col("end") >= F.col("covered"))
    return joined.groupBy("file_id", "obj_num").agg(F.min("end").alias("revision_end"), F.min_by("revision", "end").alias("revision"))


def mdp_compliance(found: DataFrame, changes: DataFrame) -> DataFrame:
    """``file_id, obj_num, mdp_level, compliant``: whether what came after a certification is allowed at its level.

    ``changes``: classified changes since the signed revision (``file_id, verdict, type,
    subtype``). Level 1 allows none but what later signatures add, level 2 form filling too,
    level 3 annotations as well.
    """
    kind = F.coalesce("subtype", "type", F.lit(""))
    signing = F.coalesce(F.col("type").isin("Sig", "DSS", "VRI", "XRef", "ObjStm"), F.lit(False))
    needs = F.when(signing, 1).when((F.col("verdict") == "permitted") | (kind == "Widget"), 2).when(F.coalesce(F.col("type") == "Annot", F.lit(False)), 3).otherwise(4)
    worst = changes.groupBy("file_id").agg(F.max(needs).alias("needs"))
    joined = found.where("mdp_level is not null").join(worst, "file_id", "left")
    return joined.select("file_id", "obj_num", "mdp_level", (F.coalesce("needs", F.lit(1)) <= F.col("mdp_level")).alias("compliant"))


def vri_key(contents: Column) -> Column:
    """The name under which a document security store keeps what validates a signature: the SHA-1 of its contents."""
    return F.upper(F.sha1(contents))
