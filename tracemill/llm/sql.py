"""Pieces of SQL for the independent engine."""


def crc32(value: str) -> str:
    """The unsigned CRC-32 of an integer's decimal digits, by its bitwise definition."""
    octet = "list_reduce([x] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    octets = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {octets}, lambda c, b: list_transform([xor(c, b)], lambda x: {octet})[1]), 4294967295)"
