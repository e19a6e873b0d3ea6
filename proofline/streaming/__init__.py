"""The row-local operators on streams of arriving documents."""
