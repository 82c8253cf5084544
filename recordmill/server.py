"""A read-only tool server over standard input and output: a JSON-RPC message a line, for programs that ask a store.

Tools look at a store and never change it. A request that can't be met is an answer with an error, and the server
goes on; what is larger than a response may be is cut as reads are.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import functions as F

from recordmill import store as stores
from recordmill.operators import search
from recordmill.plans.jq.compiler import jq
from recordmill.plans.jq.syntax import JqError
from recordmill.sources.records import InputError

# Fixed values of the protocol: its version, and the codes of errors.
PROTOCOL, BAD_JSON, BAD_REQUEST, NO_METHOD, BAD_ARGUMENTS = "2025-06-18", -32700, -32600, -32601, -32602
#: Bytes of an answer, and its rows.
MOST_BYTES, MOST_ROWS = 64 << 10, 200
TEXT, COUNT = {"type": "string"}, {"type": "integer", "minimum": 1, "maximum": MOST_ROWS}
TOOLS = {
    "status": ("Counts of notes and records", {}),
    "review": ("Stale notes and open actions", {"now": TEXT, "limit": COUNT}),
    "validate": ("Problems of notes, records and links", {"limit": COUNT}),
    "read": ("One note or record by path, source:id or address", {"target": TEXT}),
    "query": ("Search by pattern or jq program, in a scope", {"pattern": TEXT, "jq": TEXT, "scope": TEXT, "kind": TEXT, "source": TEXT, "limit": COUNT}),
}
REQUIRED = {"read": ["target"]}


def rows_of(df, limit: int) -> dict:
    found = [json.loads(x) for x in df.limit(limit + 1).toJSON().collect()]
    return {"items": found[:limit], "truncated": len(found) > limit}


def call(store: stores.Store, name: str, a: dict) -> dict:
    if unknown := set(a) - set(TOOLS[name][1]):
        raise InputError(f"unknown arguments {sorted(unknown)}")
    if missing := [k for k in REQUIRED.get(name, []) if k not in a]:
        raise InputError(f"missing arguments {missing}")
    limit = a.get("limit", search.DEFAULT)
    if type(limit) is not int or not 1 <= limit <= MOST_ROWS or not all(isinstance(v, str) for k, v in a.items() if k != "limit"):
        raise InputError("an argument has another type")
    if name == "status":
        return rows_of(store.records().groupBy("kind").agg(F.count("*").alias("records")).orderBy("kind"), limit) | {"latest_seq": store.latest_seq()}
    if name == "review":
        return rows_of(store.review(a.get("now", stores.now_text())), limit)
    if name == "validate":
        return rows_of(store.validate().orderBy("kind", "ref", "msg"), limit)
    rows = store.records()
    if name == "read":
        found = search.point_read(rows, a["target"], store.name).first()
        if found is None:
            raise InputError(f"nothing at {a['target']}")
        return search.within_bytes({"ref": found["ref"], "kind": found["kind"], "path": found["path"], "record": json.loads(found["line"]), "text": found["text"]}, MOST_BYTES)
    q = search.Query(pattern=a.get("pattern"), scope=a.get("scope"), kind=a.get("kind"), source=a.get("source"))
    found = q.rows(rows, F.col("line"))
    if "jq" in a:
        return rows_of(jq(found.drop("line"), a["jq"], "path"), limit)
    return rows_of(found.orderBy("path").select("ref", "path", "source", "kind", "title", search.snippet(F.col("text"), a.get("pattern") or "^").alias("snippet")), limit)


def described() -> list[dict]:
    return [{"name": n, "description": said, "inputSchema": {"type": "object", "properties": shape, "required": REQUIRED.get(n, []), "additionalProperties": False}, "annotations": {"readOnlyHint": True}} for n, (said, shape) in TOOLS.items()]


def answer(store: stores.Store, message: object) -> dict | None:
    """The answer to a message; None for a notification."""
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return failure(None, BAD_REQUEST, "not a request")
    method, number, given = message["method"], message.get("id"), message.get("params") or {}
    if number is None:
        return None
    if method == "initialize":
        return {"jsonrpc": "2.0", "id": number, "result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "recordmill", "version": str(stores.settings.VERSION)}}}
    if method == "ping":
        return {"jsonrpc": "2.0", "id": number, "result": {}}
    if method == "tools/list":
        return {"jsonrpc": "2.0", "id": number, "result": {"tools": described()}}
    if method != "tools/call":
        return failure(number, NO_METHOD, method)
    name, arguments = given.get("name"), given.get("arguments") or {}
    if name not in TOOLS or not isinstance(arguments, dict):
        return failure(number, BAD_ARGUMENTS, f"no tool {name}")
    try:
        value, wrong = json.dumps(call(store, name, arguments), ensure_ascii=False), False
    except (InputError, JqError, ValueError) as error:
        value, wrong = str(error), True
    return {"jsonrpc": "2.0", "id": number, "result": {"content": [{"type": "text", "text": value}], "isError": wrong}}


def failure(number: object, code: int, said: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": said}}


def serve(store: stores.Store, lines: TextIO = sys.stdin, write: Callable[[str], object] = sys.stdout.write) -> None:
    """Answer messages until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            out = answer(store, json.loads(line))
        except json.JSONDecodeError as error:
            out = failure(None, BAD_JSON, str(error))
        if out is not None:
            write(json.dumps(out, ensure_ascii=False) + "\n")
