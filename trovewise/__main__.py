"""python -m trovewise: see plans.tools."""

from .plans.tools import main

main()
