"""Pages for tests: columns of (kind, line) laid out in boxes."""

BOX = "struct<x0: int, y0: int, x1: int, y1: int, conf: float>"
SCHEMA = f"doc_id long, text string, line_boxes array<{BOX}>, x0_ int"


def page(columns, interleaved=False):
    """(text, boxes); kinds are a article, d advert, h headline."""
    placed = []
    for c, lines in enumerate(columns):
        y = 100 + c
        for n, (kind, line) in enumerate(lines):
            tall = {"a": 20, "d": 16, "h": 34}[kind]
            shift = 26 if kind == "d" else n % 3 - 1
            placed.append((y if interleaved else c, y, (60 + 430 * c + shift, y, 460 + 430 * c - shift, y + tall, 0.9), line))
            y += tall + 6
    placed.sort(key=lambda p: (p[0], p[1]))
    return "\n".join(p[3] for p in placed), [p[2] for p in placed]
