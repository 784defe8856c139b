"""`python -m lonja`."""

from lonja.commands import main

main()
