def path_of(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def roots(n, links):
    """Least member of each node's component, by union and find."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
