"""One BLAS thread in each Python worker.

Tasks fill an executor's cores already. A worker whose BLAS starts a thread for each of them spends
more time on waiting threads than on small products: scoring took three times the CPU seconds.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

#: Names by which builds of OpenBLAS export the setter.
SETTERS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


@lru_cache(1)
def one_thread() -> bool:
    """Tell the OpenBLAS that numpy has loaded to use one thread; False where there is none to be told."""
    import numpy  # noqa: F401

    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return False
    told = False
    for path in paths:
        library = ctypes.CDLL(path)
        for name in SETTERS:
            if hasattr(library, name):
                getattr(library, name)(ctypes.c_int(1))
                told = True
                break
    return told
