"""Secret scan with structural confirmation.

Base spans (assignments to secret names, access key ids, long hexadecimal runs) are reported as
they are. Beyond them, encoded candidates are cut from the text (PEM blocks, base64 and
hexadecimal runs, dotted tokens), decoded, and reported only if the bytes have the structure of a secret: a private key in DER
(PKCS#8, encrypted PKCS#8, PKCS#1, SEC1, DSA) whose nested lengths add up, a private key file of
SSH, an encrypted PEM block of a private key, or a signed token whose header and payload are JSON
with an algorithm. Runs on following lines (line ends as they are or escaped, up to 32 blanks around
them) are one block; a key may begin with any of its lines and ends where its own lengths say, which
must be the end of a line. Public keys and certificates are none. Of added spans that overlap the first by
kind (pem, jwt, der, ssh), then the longest, is reported.

Patterns run in Spark; the candidates, and texts that hold such a run, go to Python. Null texts count as empty. Added
spans may lie inside base spans. Repeated rows stay.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, span_text, spans, table, whole

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("pem", "jwt", "der", "ssh")

# The base patterns, in forms that take linear time.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
# Where a run begins (the n or r of an escaped line end isn't part of it), a line end as it is or escaped, with
# blanks around it, and how a token begins whose header is JSON: an open brace or white space, in base64.
FROM = r"(?:(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nr])|(?<=\\[nr]))"
END = r"[\x20\t]{0,32}(?:\r?\n|\\+r\\+n|\\+[nr])[\x20\t]{0,32}"
HEAD = r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))(?:e[wy]|I[ACH]|C[QSXgin]|D[QSX]|77u_)"
BODY = r"[A-Za-z0-9+/=\s\\:,]++"
# Candidates for decoding, none with a largest length.
WIDE = {
    "pem": r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----" + BODY + "(?:-" + BODY + r"){0,12}+-----END [A-Z0-9 ]{0,30}PRIVATE KEY-----",
    "jwt": HEAD + r"[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+",
    "run": FROM + r"[A-Za-z0-9+/_-]{24,}+={0,2}",
}
GATES = {"assign": r"[:=]", "access": "AKIA", "hex": r"(?<![0-9a-f])[0-9a-f]{24}", "pem": "-----BEGIN ", "jwt": HEAD + r"[A-Za-z0-9_-]{10,}+\.", "run": FROM + r"[A-Za-z0-9+/_-]{24}"}
#: What is looked at behind a run: a line end and a last line that is shorter than a run.
BEHIND = 112
NEXT = re.compile(END)
LAST = re.compile(END + r"([A-Za-z0-9+/_-]{1,23})(?![A-Za-z0-9+/_-])(={0,2})")


def unbase64(text: str) -> bytes | None:
    body = re.sub(r"\s|\\+[nrt]?", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if not re.fullmatch(r"[A-Za-z0-9+/]*", body) or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of a run of DER elements; None if the lengths don't add up to it."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        found.append((tag, data[at : at + n]))
        at += n
    return found


INTEGER, BITS, OCTETS, OBJECT, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def is_private(data: bytes) -> bool:
    """One DER sequence over all bytes, with the fields of a private key."""
    top = elements(data)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    fields = elements(top[0][1])
    if not fields:
        return False
    tags = [t for t, _ in fields]
    algorithm = lambda x: x[0] == SEQUENCE and bool(inner := elements(x[1])) and inner[0][0] == OBJECT and 3 <= len(inner[0][1]) <= 16
    version = fields[0][1] if tags[0] == INTEGER else None
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8
        return version in (b"\0", b"\1") and algorithm(fields[1]) and len(fields[2][1]) >= 16
    if tags == [SEQUENCE, OCTETS]:  # the same, encrypted
        return algorithm(fields[0]) and len(fields[1][1]) >= 32
    if set(tags[:9]) == {INTEGER} and len(tags) in (9, 10):  # PKCS#1: modulus, exponents, primes, coefficient
        return version in (b"\0", b"\1") and len(fields[1][1]) >= 48 and all(x for _, x in fields)
    if tags == [INTEGER] * 6:  # DSA
        return version == b"\0" and len(fields[1][1]) >= 48 and len(fields[5][1]) >= 16
    if tags[:2] == [INTEGER, OCTETS]:  # SEC1
        return version == b"\1" and 16 <= len(fields[1][1]) <= 66 and all(t in (0xA0, 0xA1) and elements(x) for t, x in fields[2:])
    return False


def ssh_length(data: bytes) -> int | None:
    """The bytes of a private key file at the start of data: after its mark, cipher, derivation and its options, a count, that many public keys, and the private part, each with a 32-bit length."""
    if not data.startswith(b"openssh-key-v1\0"):
        return None
    at = 15

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if not all(x is not None for x in (field(), field(), field())):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 16 and all(field() for _ in range(keys)) and bool(field()) else None


def is_ssh(data: bytes) -> bool:
    return bool(data) and ssh_length(data) == len(data)


def der_length(data: bytes) -> int | None:
    """The bytes of the DER sequence that begins data, by its own length field."""
    if len(data) < 6 or data[0] != SEQUENCE:
        return None
    n, k = data[1], data[1] & 0x7F
    if not n & 0x80:
        return n + 2
    return 2 + k + int.from_bytes(data[2 : 2 + k], "big") if 1 <= k <= 4 else None


def is_token(text: str) -> bool:
    """header.payload.signature: JSON objects, the header with an algorithm, a signature unless that is none."""
    head, body, sign = (text.split(".") + ["", ""])[:3]
    try:
        header, payload = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or len(unbase64(sign) or b"") >= 16


def confirm(kind: str, text: str) -> str | None:
    """The kind of secret that a candidate is, or None."""
    if kind == "jwt":
        return "jwt" if is_token(text) else None
    if kind == "pem":
        inside = re.sub(r"-----(BEGIN|END) [A-Z0-9 ]+-----", "", text)
        body = re.split(r"DEK-Info:[\x20\t]*[A-Z0-9-]+,[0-9A-Fa-f]+", inside)
        data = unbase64(body[-1])
        if len(body) == 2 and re.search(r"Proc-Type:[\x20\t]*4,ENCRYPTED", body[0]):
            return "pem" if data and len(data) >= 32 and len(data) % 8 == 0 else None
        return "pem" if data and (is_private(data) or is_ssh(data)) else None
    for data in ((bytes.fromhex(text) if re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", text) else None), unbase64(text)):
        if data and is_private(data):
            return "der"
        if data and is_ssh(data):
            return "ssh"
    return None


def joined(runs: list[dict]) -> Iterator[list[tuple[int, int, str]]]:
    """Runs that are lines of one block, as lists of (start, end, characters); a last line shorter than a run belongs to it."""
    block: list[tuple[int, int, str]] = []
    for i, x in enumerate(runs):
        block.append((x["s"], x["e"], x["m"].rstrip("=")))
        after = NEXT.match(x["r"])
        if after and "=" not in x["m"] and i + 1 < len(runs) and runs[i + 1]["s"] == x["e"] + after.end():
            continue
        short = LAST.match(x["r"]) if "=" not in x["m"] else None
        if short:
            block.append((x["e"] + short.start(1), x["e"] + short.end(), short[1]))
        yield block
        block = []


def keys_in(block: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys that begin with a line of a block and end with the same or a later one, where their own lengths say."""
    i = 0
    while i < len(block):
        found = None
        if block[i][2][0] == "M" or block[i][2].startswith("b3BlbnNzaC1rZXkt"):
            der = block[i][2][0] == "M"
            rest = None if der else unbase64("".join(x[2] for x in block[i:])[: 4 * (sum(len(x[2]) for x in block[i:]) // 4)])
            length = der_length(unbase64(block[i][2][:16]) or b"") if der else ssh_length(rest or b"")
            need, have = -(-(length or 0) * 4 // 3), 0
            for j in range(i, len(block) if length else i):
                have += len(block[j][2])
                if have >= need:
                    if have == need and confirm("run", "".join(x[2] for x in block[i : j + 1])):
                        found = j
                    break
        if found is None:
            i += 1
        else:
            yield ("der" if block[i][2][0] == "M" else "ssh"), block[i][0], block[found][1]
            i = found + 1


def confirmed_in(candidates: list[dict], text: str) -> list[dict]:
    """The secrets among the candidates (kind, s, e, m) of one text, in order."""
    found = [(kind, x["s"], x["e"]) for x in candidates if (kind := confirm(x["kind"], x["m"]))]
    for block in joined([{**x, "r": text[x["e"] : x["e"] + BEHIND]} for x in candidates if x["kind"] == "run"]):
        if len(block) > 1:
            found += keys_in(block)
    return [{"kind": k, "s": s, "e": e} for k, s, e in dict.fromkeys(found)]


def confirmed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for found, texts in batches:
        yield pd.Series([confirmed_in([x if isinstance(x, dict) else x.asDict() for x in c], t) if len(c) else [] for c, t in zip(found, texts, strict=True)], dtype=object)


def base_spans(text: Column) -> Column:
    """array<struct<k,kind,s,e>> of the base, by start and kind as listed."""
    found = [base_of(k, kind, spans(text, BASE[kind], 0, GATES[kind])) for k, kind in enumerate(BASE_KINDS)]
    return by_start(F.concat(*found))


def base_of(k: int, kind: str, matches: Column) -> Column:
    def ok(x: Column) -> Column:
        if kind == "assign":
            return F.length(F.regexp_extract(x["m"], VALUE, 1)) >= 6
        return F.length(x["m"]) >= (20 if kind == "access" else 24)

    return F.transform(F.filter(matches, ok), lambda x: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def by_start(found: Column) -> Column:
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.transform(ordered, lambda x: F.struct(x["k"].alias("k"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def wide_of(kind: str, text: Column) -> Column:
    return F.transform(spans(text, WIDE[kind], 0, GATES[kind]), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


def scan(docs: DataFrame, text_col: str = "text", base_col: str = "base", all_col: str = "spans") -> DataFrame:
    """docs with two columns of array<struct<k,kind,s,e>>: the base, and all spans, both by start and kind.

    Where docs has a column of such a name, the new one gets underscores in front.
    """
    base_col, all_col, t, c, v = fresh(docs, base_col, all_col, "secret_text", "secret_candidates", "secret_verdicts")
    out = docs.withColumn(t, whole(F.col(text_col)))
    out = out.withColumn(c, F.concat(*[wide_of(kind, F.col(t)) for kind in WIDE]))
    out = out.withColumn(v, F.pandas_udf(confirmed, "array<struct<kind: string, s: int, e: int>>")(F.col(c), F.when(F.exists(c, lambda x: x["kind"] == "run"), F.col(t)).otherwise("")))
    rank = F.create_map(*[y for i, kind in enumerate(ADDED_KINDS) for y in (F.lit(kind), F.lit(i + len(BASE_KINDS)))])
    found = F.transform(v, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("k"), (x["s"] - x["e"]).alias("n"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    ordered = F.array_sort(found)
    plain = lambda x: F.struct(x["k"].alias("k"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    added = F.aggregate(ordered, F.array().cast("array<struct<k:int,kind:string,s:int,e:int>>"), lambda a, x: F.when(F.exists(a, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])), a).otherwise(F.concat(a, F.array(plain(x)))))
    out = out.withColumn(base_col, base_spans(F.col(t)))
    return out.withColumn(all_col, F.when(F.size(v) > 0, by_start(F.concat(F.col(base_col), added))).otherwise(F.col(base_col))).drop(t, c, v)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
