"""Plain loops shared by the tests."""


def next_fit(sizes, cap):
    out, used, chunk = [], 0, 0
    for b in sizes:
        if used > 0 and used + b > cap:
            chunk, used = chunk + 1, 0
        used += b
        out.append(chunk)
    return out
