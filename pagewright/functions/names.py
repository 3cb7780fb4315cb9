"""Names made unique."""

from __future__ import annotations


def free_name(name: str, suffix: str, taken: dict[str, str]) -> str:
    """name, or where it is taken the same with the suffix, again and again, until it is free; then it is taken.

    ``taken`` has each name that is taken, and the last one that was found free from it: what lies between never comes free,
    so that a search goes on where the one before has ended.
    """
    free = taken.get(name, name)
    while free in taken:
        further = taken[free]
        free = further if further != free else free + suffix
    taken[name] = taken[free] = free
    return free
