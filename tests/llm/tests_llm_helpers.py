def components_of(fps, bits=4):
    """For each fingerprint the position of the first one of its component, over all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if ((fps[a] ^ fps[b]) & ((1 << 64) - 1)).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]
