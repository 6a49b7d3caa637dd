import hashlib


def words(seed, n, size=400):
    """Deterministic made-up words."""
    out = []
    for i in range(n):
        h = int(hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), 16)
        out.append("".join(chr(97 + (h % size * 7919 >> s) % 26) for s in (0, 3, 6, 9)))
    return out
