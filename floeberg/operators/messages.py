"""Cost model of block multiplication with asynchronous messages.

The product itself is ``sparse.block_multiply``; this simulates the clock of a
grid of processors on the driver, from block sizes alone."""

from __future__ import annotations

import heapq


def cannon_clock(nnz_a: list[list[int]], nnz_b: list[list[int]], send: float = 10.0, receive: float = 10.0, inverse_bandwidth: float = 1.0, flop: float = 1.0) -> dict:
    """Finish time and messages of a p x p grid that passes blocks around a torus.

    Processor (i, j) multiplies A(i, k) with B(k, j) as soon as both arrived;
    a block of n entries takes n * inverse_bandwidth on the way."""
    p = len(nnz_a)
    events: list = []
    arrived = {(i, j): ({}, {}) for i in range(p) for j in range(p)}
    clock = {(i, j): 0.0 for i in range(p) for j in range(p)}
    sent = 0
    for i in range(p):
        for k in range(p):
            for j in range(p):
                far_a, far_b = (k - j) % p, (k - i) % p
                heapq.heappush(events, (far_a * (send + receive + nnz_a[i][k] * inverse_bandwidth), i, j, 0, k))
                heapq.heappush(events, (far_b * (send + receive + nnz_b[k][j] * inverse_bandwidth), i, j, 1, k))
                sent += (far_a > 0) + (far_b > 0)
    while events:
        t, i, j, side, k = heapq.heappop(events)
        arrived[i, j][side][k] = t
        if k in arrived[i, j][1 - side]:
            clock[i, j] = max(clock[i, j], t) + flop * nnz_a[i][k] * max(nnz_b[k][j], 1)
    return {"finish": max(clock.values(), default=0.0), "messages": sent, "clocks": clock}
