"""spark-submit launcher for ``tickfeatures.jobs`` (see that module for the commands)."""

from tickfeatures.jobs import main

if __name__ == "__main__":
    main()
