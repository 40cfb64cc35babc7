"""Plain helpers of the tests."""


def brute_components(codes, radius):
    up = {i: i for i in codes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(codes)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (codes[a] ^ codes[b]).bit_count() <= radius and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """Ids that stay, by comparing all pairs."""
    ids, sets, up = sorted(texts), {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common * 10 >= 8 * (len(sets[a]) + len(sets[b]) - common):
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i for i in ids if root(i) == i}
