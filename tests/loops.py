"""Plain Python loops that say what the set-based operators must compute."""


def anchored(events, window):
    """(key, sec, weight) in time order -> (key, sec, anchor, hits before), one per unit of weight."""
    state, out = {}, []
    for key, sec in sorted(events):
        start, seen = state.get(key, (None, 0))
        if start is None or sec >= start + window:
            start, seen = sec, 0
        out.append((key, sec, start, seen + 1))
        state[key] = (start, seen + 1)
    return out


def alarm(events, n, window, mode):
    """Firing hits (key, sec, number of the hit in its window)."""
    fires = {
        "threshold": lambda i: i % n == 0,
        "both": lambda i: i == n,
        "limit": lambda i: i <= n,
        "every": lambda i: i >= n,
    }[mode]
    return sorted((k, s, i) for k, s, _, i in anchored(events, window) if fires(i))


def zeek_reset(events, n, window):
    """The counter as a script would keep it: zero on firing, window start kept."""
    table, out = {}, []
    for key, sec in sorted(events):
        if key not in table or sec >= table[key][0] + window:
            table[key] = [sec, 0]
        table[key][1] += 1
        if table[key][1] >= n:
            out.append((key, sec))
            table[key][1] = 0
    return sorted(out)


def distinct(events, n, window):
    """(key, sec, item) -> (key, sec, hits, items known) for firing seconds."""
    table, out = {}, []
    seconds = {}
    for key, sec, item in events:
        seconds.setdefault((key, sec), []).append(item)
    for (key, sec), items in sorted(seconds.items()):
        if key not in table or sec >= table[key][0] + window:
            table[key] = (sec, set())
        table[key][1].update(items)
        if len(table[key][1]) >= n:
            out.append((key, sec, len(items), len(table[key][1])))
    return sorted(out)


def logins(events, n, window):
    """(key, sec, success) -> (brute-force firings, successes after failures)."""
    table, brute, won = {}, [], []
    for key, sec, ok in sorted(events):
        if key in table and sec >= table[key][0] + window:
            del table[key]
        if not ok:
            table.setdefault(key, [sec, 0])
            table[key][1] += 1
            if table[key][1] >= n:
                brute.append((key, sec, table[key][1]))
        elif key in table and table[key][1] > 0:
            won.append((key, sec, table[key][1]))
            table[key][1] = 0
    return sorted(brute), sorted(won)


def rapid(tries, shorts, n, window):
    """Attempts count and fire, short sessions only count; attempts first inside a second."""
    table, out = {}, []
    events = [(k, s, 0) for k, s in tries] + [(k, s, 1) for k, s in shorts]
    for key, sec, kind in sorted(events):
        if key not in table or sec >= table[key][0] + window:
            table[key] = [sec, 0]
        table[key][1] += 1
        if kind == 0 and table[key][1] >= n:
            out.append((key, sec, table[key][1]))
            table[key][1] = 0
    return sorted(out)


def trailing(events, seconds, more_than):
    out = []
    for key in {k for k, _ in events}:
        mine = sorted(s for k, s in events if k == key)
        for i, sec in enumerate(mine):
            count = sum(1 for s in mine[: i + 1] if s > sec - seconds)
            if count > more_than:
                out.append((key, sec, count))
    return sorted(out)


def ssh_log(tries, shorts, fails_n, rapid_n, window):
    """(key, sec, success) attempts and (key, sec) short sessions -> (key, sec, kind, attempts, failures)."""
    fail, conn, out = {}, {}, []
    events = [(k, s, int(ok)) for k, s, ok in tries] + [(k, s, 2) for k, s in shorts]
    for key, sec, kind in sorted(events):
        for table in (fail, conn):
            if key in table and sec >= table[key][0] + window:
                del table[key]
        conn.setdefault(key, [sec, 0])[1] += 1
        if kind == 2:
            continue
        failures = fail.get(key, [0, 0])[1]
        if kind == 0:
            fail.setdefault(key, [sec, 0])[1] += 1
            failures = fail[key][1]
            if failures >= fails_n:
                out.append((key, sec, "bruteforce", conn[key][1], failures))
        elif failures:
            out.append((key, sec, "bruteforce_success", conn[key][1], failures))
            fail[key][1] = failures = 0
        if conn[key][1] >= rapid_n:
            out.append((key, sec, "rapid_connections", conn[key][1], failures))
            conn[key][1] = 0
    return sorted(out)
