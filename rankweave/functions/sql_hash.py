"""SQL text of the md5 hash of ``hashing.hash32``."""


def md5_draw(*parts) -> str:
    """Strings are SQL expressions; other values are literals."""
    joined = " || '-' || ".join(p if isinstance(p, str) else f"'{p}'" for p in parts)
    return f"('0x' || substr(md5({joined}), 1, 8))::BIGINT"
