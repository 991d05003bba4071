"""Where tables live, and what else can be read and written."""
