"""Hashes, key slots and IPv4 arithmetic as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
USER_SEED = 0x12345678
SLOTS = 16384


def cache_key(query: Column, database: Column, table: Column) -> Column:
    return F.substring(F.sha2(F.concat(query, database, table), 256), 1, 32)


def tracking_key(query: Column, database: Column) -> Column:
    return F.substring(F.sha2(F.concat(query, database), 256), 1, 16)


def tiered_cache_key(database: Column, table: Column, query: Column, user: Column) -> Column:
    return F.substring(F.sha2(F.concat(database, table, query, user), 256), 1, 32)


def hash_u64(text: Column) -> Column:
    """Leading eight digest bytes as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_u32(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def _mul32(a: Column, c: int) -> Column:
    """``a * c`` modulo 2**32 without leaving signed 64-bit range."""
    low = a.bitwiseAND(0xFFFF) * F.lit(c).cast("bigint")
    high = (F.shiftright(a, 16) * F.lit(c).cast("bigint")).bitwiseAND(0xFFFF)
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK32).cast("bigint"))


def mix32(value: Column, seed: Column) -> Column:
    """32-bit mix of a value under a seed, as a non-negative long."""
    h = value.cast("bigint").bitwiseXOR(seed.cast("bigint")).bitwiseAND(F.lit(MASK32).cast("bigint"))
    h = _mul32(h, 0x85EBCA6B)
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = _mul32(h, 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))


def crc16_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x1021) & 0xFFFF if crc & 0x8000 else (crc << 1) & 0xFFFF
        table.append(crc)
    return table


def key_slot(key: Column) -> Column:
    """CRC16 (0x1021, start 0) of the key, or of its first ``{tag}``, modulo 16384.

    An empty tag ``{}`` hashes the empty string.
    """
    hashed = F.when(key.rlike(r"(?s)\{.*?\}"), F.regexp_extract(key, r"(?s)\{(.*?)\}", 1)).otherwise(key)
    digits = F.hex(F.encode(hashed, "utf-8"))
    count = F.floor(F.length(digits) / 2).cast("int")
    positions = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    byte_at = lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
    table = F.lit(crc16_table())

    def step(acc: Column, i: Column) -> Column:
        index = F.shiftright(acc, 8).bitwiseXOR(byte_at(i)).bitwiseAND(0xFF)
        return F.shiftleft(acc, 8).bitwiseAND(0xFFFF).bitwiseXOR(F.element_at(table, index + 1).cast("int"))

    return F.pmod(F.aggregate(positions, F.lit(0), step), F.lit(SLOTS))


IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def strip_port(address: Column) -> Column:
    return F.regexp_replace(address, r":\d+$", "")


def ip_to_long(ip: Column) -> Column:
    """IPv4 text to a long; null when it is not four octets of at most 255."""
    octets = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(IPV4) & (F.greatest(*octets) <= 255), value)


def long_to_ip(value: Column) -> Column:
    part = lambda shift: F.shiftright(value, shift).bitwiseAND(255).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def prefix_mask(prefix: Column | int) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, int) else prefix
    all_ones = F.lit(MASK32).cast("bigint")
    return all_ones - (F.pow(F.lit(2.0), F.lit(32) - prefix).cast("bigint") - 1)


def session_key(ip: Column, port: Column) -> Column:
    return F.shiftleft(ip.cast("bigint"), 16).bitwiseOR(port.cast("bigint"))
