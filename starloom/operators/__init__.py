"""DataFrame-to-DataFrame operators that know nothing about the star schema."""
