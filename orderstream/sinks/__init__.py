"""Writers. Every writer is safe to repeat for the same batch id."""
