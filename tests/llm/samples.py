"""Texts that the tests share."""

PROSE = (
    "the river ran low that summer and the boats lay on the mud while people walked across to the island "
    "and found old coins under the stones where the ferry used to land before the bridge was built by hand"
)


def letters(n: int) -> str:
    """Another word for each number."""
    out = ""
    while True:
        out += "abcdefghij"[n % 10]
        n //= 10
        if not n:
            return "w" + out


def fresh(seed: int, n: int) -> str:
    """``n`` words that no other seed has."""
    return " ".join(letters(seed * 100_000 + i) for i in range(n))
