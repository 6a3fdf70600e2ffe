"""Step-by-step restatements of the sequence rules, used as the truth in tests."""


def debounce(levels, up, down, after, top=2, names=3):
    committed, streak_level, streak, held, tiers = 0, None, 0, 0, []
    for level in levels:
        streak = streak + 1 if level == streak_level else 1
        streak_level = level
        if level != committed and streak >= (up if level > committed else down):
            committed = level
        held = held + 1 if committed == top else 0
        tiers.append(committed + 1 if committed == top and held >= after else committed)
    return tiers


def runs_at_or_above(values, threshold):
    inside, out = False, []
    for i, v in enumerate(values):
        if v is None or v != v:
            if inside:
                out[-1][1] = i
        elif v >= threshold:
            if not inside:
                out.append([i, i])
            out[-1][1] = i
            inside = True
        else:
            inside = False
    return [tuple(r) for r in out]


def majority(stamps, zones, window):
    kept, out = [], []
    for now, zone in zip(stamps, zones):
        if zone is None:
            kept = []
            out.append(None)
            continue
        kept.append((now, zone))
        kept = [k for k in kept if k[0] >= now - window]
        names = [z for _, z in kept]
        best = max(names.count(z) for z in names)
        out.append(next(z for z in reversed(names) if names.count(z) == best))
    return out


def streak(stamps, flags, short, long):
    start, out = None, []
    for now, off in zip(stamps, flags):
        if not off:
            start = None
            out.append(0)
            continue
        start = now if start is None else start
        out.append(2 if long is not None and now - start >= long else int(now - start >= short))
    return out


def ema(vectors, every, alpha):
    state, out = None, []
    for i, v in enumerate(vectors):
        if (i + 1) % every == 0 and v is not None:
            state = list(v) if state is None else [alpha * a + (1 - alpha) * b for a, b in zip(v, state)]
        out.append(state)
    return out
