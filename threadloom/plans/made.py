"""Inputs that the tables stand for: conversations as JSON array elements, a message forest with every anomaly, an archive's directory.

Expressions are plain SQL that Spark and DuckDB read alike, so a query and its oracle have
the same input and share nothing else.
"""

from __future__ import annotations

import io
import json
import warnings
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import linkage
from ..sources.stored import new_folder
from ..sources.tables import table

PER_SHARD = 25  # conversations
PER_ARCHIVE = 1000  # members

UP = "CAST(floor((turn - 1) / 2) AS BIGINT)"
#: Columns of a node: ``a`` says which flaw its conversation has, if any.
SPEC = "conv_id AS c, turn, role, text, conv_id % 18 AS a"
NODE = "concat('n', turn)"
KIND = "CASE WHEN a = 2 AND turn = 0 THEN 'absent' WHEN a = 3 AND turn = last THEN 'invalid' WHEN a = 4 AND turn = last THEN 'string' WHEN a = 5 AND turn = last THEN 'null' WHEN a = 6 AND turn = 0 THEN 'string' WHEN turn = 0 THEN 'null' ELSE 'string' END"
PARENT = f"CASE WHEN a = 3 AND turn = last THEN '5' WHEN a = 4 AND turn = last THEN 'nowhere' WHEN a = 5 AND turn = last THEN NULL WHEN a = 6 AND turn = 0 THEN 'n0' WHEN turn = 0 THEN NULL ELSE concat('n', {UP}) END"
MESSAGE = "CASE WHEN a = 13 AND turn = 0 THEN 'absent' WHEN a = 14 AND turn = 0 THEN 'null' ELSE 'object' END"
MESSAGE_ID = "CASE WHEN a = 15 THEN concat('shared-', turn) ELSE concat('m', c, '-', turn) END"
ROLE = "CASE WHEN turn % 5 = 4 THEN 'moderator' ELSE role END"
TYPE = "CASE WHEN turn % 3 = 0 THEN 'text' WHEN turn % 3 = 1 THEN 'code' ELSE 'widget' END"
TIME = "concat(1700000000 + turn, '.5')"
CURRENT = "CASE WHEN a = 9 THEN NULL WHEN a = 10 THEN 'zz' ELSE concat('n', last) END"
NAMED = "(c + turn) % 25"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """c, turn, role, a, last, node, kind, parent, message, message_id, type, and ``body``, the node as a JSON member."""
    t = table(spark, d, "conversations").selectExpr(SPEC.split(", ", 1)[0], *SPEC.split(", ")[1:])
    t = t.withColumn("last", F.max("turn").over(Window.partitionBy("c")))
    t = t.selectExpr("*", f"{NODE} AS node", f"{KIND} AS kind", f"{PARENT} AS parent", f"{MESSAGE} AS message", f"{MESSAGE_ID} AS message_id", f"{ROLE} AS role_", f"{TYPE} AS type", f"{TIME} AS at", f"{NAMED} AS named")
    refs = F.expr("""CASE WHEN role = 'user' THEN concat(',{"asset_pointer":"sediment://payload-', named, '.dat"}') ELSE '' END""")
    more = F.expr("""CASE WHEN role = 'user' THEN concat('{"attachments":[{"id":"asset-', named, '"},"bare",{"file_id":"file-', named, '"}],"url":"no"}') ELSE '{}' END""")
    head = F.expr("""concat('{"id":"', message_id, '","author":{"role":"', role_, '"},"create_time":', at, ',"update_time":null,"content":{"content_type":"', type, '","parts":[')""")
    said = F.concat(head, F.coalesce(F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1), F.lit("null")), refs, F.lit(']},"metadata":'), more, F.lit("}"))
    message = F.when(F.col("message") == "absent", "").when(F.col("message") == "null", ',"message":null').otherwise(F.concat(F.lit(',"message":'), said))
    parent = F.expr("""CASE kind WHEN 'absent' THEN '' WHEN 'invalid' THEN concat(',"parent":', parent) WHEN 'null' THEN ',"parent":null' ELSE concat(',"parent":"', parent, '"') END""")
    children = F.expr("""CASE WHEN a = 7 AND turn = 0 THEN ',"children":1' WHEN a = 8 AND turn = 0 THEN ',"children":["q"]' ELSE '' END""")
    own = F.expr("CASE WHEN a = 1 AND turn = 0 THEN 'zz' ELSE node END")
    return t.withColumn("body", F.concat(F.lit('"'), "node", F.lit('":{"id":"'), own, F.lit('"'), parent, children, message, F.lit("}")))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """(shard, ordinal, payload): a conversation is one array element, as an export has it."""
    t = nodes(spark, d).groupBy("c", "a", "last").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), ",").alias("mapping"))
    ident = F.expr("""CASE WHEN a = 11 THEN '' WHEN a = 12 THEN concat('"id":"c', c, '","conversation_id":"other",') WHEN a = 15 THEN '"id":"c-shared",' ELSE concat('"id":"c', c, '",') END""")
    current = F.expr(f"""CASE WHEN ({CURRENT}) IS NULL THEN 'null' ELSE concat('"', {CURRENT}, '"') END""")
    payload = F.concat(F.lit("{"), ident, F.lit('"title":"t","create_time":1700000000.5,"update_time":null,"current_node":'), current, F.lit(',"mapping":{'), "mapping", F.lit("}}"))
    return t.select(F.expr(f"CAST(floor(c / {PER_SHARD}) AS BIGINT) AS shard"), F.expr(f"CAST(c % {PER_SHARD} AS INT) AS ordinal"), payload.alias("payload"))


def metadata(spark: SparkSession, d: str) -> tuple[list[str], list]:
    """Member names and ancillary JSON of an archive that holds a payload for each nation: 25 rows."""
    keys = sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())
    names = [f"payload-{k}.{'png' if k % 2 else 'dat'}" for k in keys]
    maps = {f"payload-{k}.dat": f"asset-{k}" for k in keys if k % 4 == 0}
    several = {"all": {f"asset-{k}": {"files": [f"payload-{k}.dat", f"payload-{k - 2}.dat", 7]} for k in keys if k % 4 == 2}}
    records = [{"file_id": f"file-{k}", "file_name": f"payload-{k}.dat"} for k in keys if k % 3 == 0]
    return names, [maps, several, records]


def aliases(spark: SparkSession, d: str) -> linkage.Aliases:
    return linkage.build_aliases(*metadata(spark, d))


# --- an archive's directory ------------------------------------------------------------------

#: Names by kind of member; ``@`` is the page's id.
NAMES = ["conversations-@.json", "Conversation.JSON", "chat.html", "a/b/user.json", "../../secret-@.txt", "/abs/@.pem", "C:x@.png", ".env", "backup-code-@.json", "noext", "x.tar.GZ", "dir-@/", "x.averyverylongext", "p@.dat", "q@.bundle", "photo.JPG", "doc.pdf", "names.json", "p@.dat", "q@.bundle", "movie.mp4", "data.csv", "p@.dat", "dup.json"]
#: First bytes by kind of payload, in hex.
HEADS = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "474946383761", "524946463132333457454250", "524946463132333457415645", "524946463132333441564920", "4F676753", "664C6143", "494433", "FFFB", "FFE0", "3132333466747970", "1A45DFA3", "255044462D31", "504B0304", "53514C69746520666F726D6174203300", "D0CF11E0", "1F8B", "FF1F", "", "52494646"]
NAME = f"replace(CASE page_id % {len(NAMES)} {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES))} END, '@', CAST(page_id AS VARCHAR(20)))"
HEAD = f"CASE page_id % {len(HEADS)} {' '.join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HEADS))} END"
THIRD = "CAST(floor(page_id / 3) AS BIGINT)"
#: Sizes and CRCs that triples of members share.
SIZE, PACKED, CRC, FLAGS = f"{THIRD} % 50", "page_id * 7 % 1000", f"({THIRD} * 2654435761) % 4294967296", "CASE WHEN page_id % 29 = 0 THEN 1 ELSE 0 END"


def members(spark: SparkSession, d: str) -> DataFrame:
    """Raw directory rows, one for each page."""
    pages = table(spark, d, "pages").select("page_id")
    return pages.selectExpr(
        "CAST(page_id AS INT) AS ordinal", f"{NAME} AS name", f"{SIZE} AS uncompressed_bytes", f"{PACKED} AS compressed_bytes",
        "array(2026, CAST(1 + page_id % 12 AS INT), CAST(1 + page_id % 28 AS INT), CAST(page_id % 24 AS INT), 0, 0) AS zip_timestamp",
        f"{CRC} AS crc", "0 AS compression_method", f"{FLAGS} AS flag_bits", "page_id * 100 AS header_offset", "true AS is_sampled", f"unhex({HEAD}) AS prefix",
    )


def archives(spark: SparkSession, d: str) -> list[str]:
    """ZIP files in the shared folder with the pages' HTML as members, ``PER_ARCHIVE`` ids each; written by tasks, a file under a temporary name until it is whole."""
    from pyarrow import fs

    folder = new_folder(spark, "archives")
    rows = table(spark, d, "pages").selectExpr(f"CAST(floor(page_id / {PER_ARCHIVE}) AS BIGINT) AS archive", "page_id", f"{NAME} AS name", f"{FLAGS} AS flag_bits", "coalesce(html, '') AS html")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now, body, z = None, None, None

        def close() -> pd.DataFrame:
            z.close()
            with store.open_output_stream(f"{root}/_{now}.tmp") as f:
                f.write(body.getvalue())
            store.move(f"{root}/_{now}.tmp", f"{root}/{now:08d}.zip")
            return pd.DataFrame({"name": [f"{now:08d}.zip"]})

        for x in parts:
            for archive, name, flags, html in zip(x["archive"], x["name"], x["flag_bits"], x["html"]):
                if archive != now:
                    if now is not None:
                        yield close()
                    now, body = archive, io.BytesIO()
                    z = zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", UserWarning)  # of names that occur more than once, as they may
                    z.writestr(info, b"" if name.endswith("/") else html.encode())
                info.flag_bits |= flags  # as a protected member's
        if now is not None:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = rows.repartition(n, "archive").sortWithinPartitions("archive", "page_id").mapInPandas(write, "name string")
    return [f"{folder}/{r['name']}" for r in done.orderBy("name").collect()]  # a path for each archive


def export(spark: SparkSession, d: str, path: str) -> None:
    """One export archive at ``path``: shards of the made conversations, metadata and a payload for each nation.

    An export is one file by contract, so the driver writes it, a conversation at a time.
    """
    names, ancillary = metadata(spark, d)
    stamp = (2026, 1, 1, 0, 0, 0)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, name in enumerate(names):
            z.writestr(zipfile.ZipInfo(name, stamp), bytes.fromhex(HEADS[k % len(HEADS)]) + bytes(64))
        for name, value in zip(("maps.json", "several.json", "records.json"), ancillary):
            z.writestr(zipfile.ZipInfo(name, stamp), json.dumps(value))
        now, out = None, None
        for r in conversations(spark, d).orderBy("shard", "ordinal").toLocalIterator():
            if r["shard"] != now:
                if out:
                    out.write(b"]")
                    out.close()
                now, out = r["shard"], z.open(zipfile.ZipInfo(f"conversations-{r['shard']:03d}.json", stamp), "w", force_zip64=True)
                out.write(b"[")
            else:
                out.write(b",")
            out.write(r["payload"].encode())
        if out:
            out.write(b"]")
            out.close()
