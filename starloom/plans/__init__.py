"""Jobs over the star schema: build, quality checks, analyses, layout study."""
