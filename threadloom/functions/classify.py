"""What a member's name and first bytes say about it, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def basename(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/\\]*)$", 1)


def extension(name: Column) -> Column:
    """``.ext`` in lower case, or ``[other]``; a name that only starts with a dot has none."""
    ext = F.lower(F.regexp_extract(basename(name), r"(?s)^.+(\.[^.]+)$", 1))
    return F.when(ext.rlike(r"^\.[a-z0-9]{1,10}\z"), ext).otherwise("[other]")


def entry_id(ordinal: Column) -> Column:
    return F.format_string("entry-%06d", ordinal)


def safe_name(name: Column, ordinal: Column) -> Column:
    """The name itself if it is one of the known ones, else an alias."""
    stems = "|".join(["conversations?(?:[-_]?[0-9]+)?", *K.SAFE_STEMS.split()])
    known = basename(name).rlike(rf"(?i)^(?:{stems})\.(?:json|html)\z")
    return F.when(known, basename(name)).otherwise(F.concat(entry_id(ordinal), extension(name)))


def is_conversation(name: Column) -> Column:
    return basename(name).rlike(rf"(?i)^{K.CONVERSATION_NAME}\z")


def shard_id(name: Column) -> Column:
    """``conversations-003.json`` is 3, ``conversations.json`` is 0, any other name null."""
    number = F.regexp_extract(name, rf"^{K.SHARD_NAME}\z", 1)
    return F.when(name.rlike(rf"^{K.SHARD_NAME}\z"), F.when(number == "", 0).otherwise(number.cast("long"))).cast("long")


def _one_of(ext: Column, names: str) -> Column:
    return ext.isin(*(f".{x}" for x in names.split()))


def is_media(ext: Column) -> Column:
    return _one_of(ext, K.MEDIA_EXTENSIONS)


def is_attachment(ext: Column) -> Column:
    return _one_of(ext, K.ATTACHMENT_EXTENSIONS)


def is_payload(ext: Column) -> Column:
    return _one_of(ext, K.PAYLOAD_EXTENSIONS)


def unsafe_path(name: Column) -> Column:
    return name.rlike(r"^[/\\]") | name.rlike(r"(^|[/\\])\.\.([/\\]|\z)") | name.rlike("^[A-Za-z]:")


def risk_flags(name: Column, flag_bits: Column) -> Column:
    """Flags in a fixed order."""
    flags = [
        (_one_of(extension(name), K.RISK_EXTENSIONS), K.RISK_CONTAINER),
        (name.rlike(f"(?i){K.SENSITIVE_NAME}"), K.RISK_NAME),
        (unsafe_path(name), K.RISK_PATH),
        (flag_bits.bitwiseAND(F.lit(1)) == 1, K.RISK_ENCRYPTED),
    ]
    return F.array_compact(F.array(*(F.when(on, label) for on, label in flags)))


def crc_hex(crc: Column) -> Column:
    return F.lower(F.lpad(F.hex(crc.cast("long")), 8, "0"))


def header_format(header: Column) -> Column:
    """A format by its first bytes; the first rule that fits."""
    h = F.hex(F.substring(header, 1, 64))
    starts = lambda text: h.startswith(text.encode("latin-1").hex().upper())
    at = lambda offset, text: F.substring(h, 2 * offset + 1, 2 * len(text)) == text.encode("latin-1").hex().upper()
    # Signatures in order.
    rules = [
        (starts("\x89PNG\r\n\x1a\n"), "PNG"),
        (starts("\xff\xd8\xff"), "JPEG"),
        (starts("GIF87a") | starts("GIF89a"), "GIF"),
        (starts("RIFF") & at(8, "WEBP"), "WebP"),
        (starts("RIFF") & at(8, "WAVE"), "WAV"),
        (starts("RIFF") & at(8, "AVI "), "AVI"),
        (starts("OggS"), "Ogg container"),
        (starts("fLaC"), "FLAC"),
        (starts("ID3"), "ID3 audio candidate"),
        (h.rlike("^FF[EF]"), "MPEG audio candidate"),
        (at(4, "ftyp"), "ISO-BMFF media container"),
        (starts("\x1aE\xdf\xa3"), "Matroska/WebM container"),
        (starts("%PDF-"), "PDF"),
        (starts("PK\x03\x04"), "ZIP-family container"),
        (starts("SQLite format 3\x00"), "SQLite"),
        (starts("\xd0\xcf\x11\xe0"), "OLE compound document"),
        (starts("\x1f\x8b"), "gzip container"),
    ]
    out = F.lit("unidentified")
    for on, label in reversed(rules):
        out = F.when(on, label).otherwise(out)
    return F.when(header.isNotNull(), out)


def root_type(text: Column) -> Column:
    """What a JSON text starts as."""
    first = F.substring(F.ltrim(F.regexp_replace(text, "^[\\s﻿]+", "")), 1, 1)
    return F.when(first == "[", "array").when(first == "{", "object").otherwise("unknown")


def classified(raw):
    """Members from raw directory rows (ordinal, name, sizes, crc, flags, ...)."""
    name, ordinal = F.col("name"), F.col("ordinal")
    ext = extension(name)
    return raw.select(
        entry_id(ordinal).alias("entry_id"),
        ordinal.alias("zip_directory_index"),
        safe_name(name, ordinal).alias("safe_name"),
        F.sha2(name, 256).alias("path_sha256"),
        ext.alias("extension"),
        name.endswith("/").alias("is_directory"),
        "uncompressed_bytes",
        "compressed_bytes",
        "zip_timestamp",
        crc_hex(F.col("crc")).alias("crc32"),
        "compression_method",
        is_conversation(name).alias("is_conversation_json"),
        is_media(ext).alias("is_media"),
        is_attachment(ext).alias("is_other_attachment_candidate"),
        risk_flags(name, F.col("flag_bits")).alias("risk_flags"),
        F.when(is_payload(ext) & ~name.endswith("/"), F.when(F.col("flag_bits").bitwiseAND(F.lit(1)) == 1, "encrypted-not-read").otherwise(header_format(F.col("prefix")))).alias("header_format"),
        "prefix",
    )
